"""Keyword packs: seeds through templates of several dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions.scores import stable_score
from lumenry.functions.text import ordered_list


#: Templates an expansion takes at most; they travel as a constant.
MOST_TEMPLATES = 2000


def normalize_seeds(c: Column) -> Column:
    """Up to eight seeds on one line each, told apart before they are cut to 40 characters."""
    return ordered_list(c, 8, 40)


def expand_keywords(seeds: DataFrame, templates: DataFrame, blocked: list[str], limit: int = 10) -> DataFrame:
    """(pack, dimension, rank, keyword, recommendation, business) from seeds (pack, pos, seed) and templates.

    templates has (dimension, at, template, recommend_base, business_base); `{s}` stands for the
    seed. Keywords with a blocked term drop out, equal ones of a dimension count once, the first
    `limit` by seed and template stay. Templates are a parameter table of at most MOST_TEMPLATES rows.
    """
    rows = templates.select("dimension", "at", "template", "recommend_base", "business_base").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in r.asDict()]) for r in rows])
    keyed = seeds.select("pack", "pos", "seed", F.inline(listed))
    made = keyed.withColumn("keyword", F.trim(F.replace("template", F.lit("{s}"), F.col("seed")))).where("keyword <> ''")
    for term in blocked:
        made = made.where(~F.contains(F.lower("keyword"), F.lit(term)))
    first = made.groupBy("pack", "dimension", "keyword").agg(F.min(F.struct("pos", "at", "seed", "recommend_base", "business_base")).alias("m"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("pack", "dimension").orderBy("m.pos", "m.at"))).where(F.col("rank") <= limit)
    score = lambda of, base, spread: stable_score(F.col("m.seed"), of, F.col("keyword"), F.col(f"m.{base}"), spread)
    return ranked.select("pack", "dimension", "rank", "keyword", score(F.col("dimension"), "recommend_base", 28).alias("recommendation"), score(F.concat("dimension", F.lit("-biz")), "business_base", 26).alias("business"))


def keyword_summary(keywords: DataFrame) -> DataFrame:
    """Per pack: keywords, rounded mean scores and the percentages of scores of 80 and more."""
    share = lambda c: F.bround(F.count_if(F.col(c) >= 80) * 100.0 / F.count(F.lit(1)), 0).cast("int")
    return keywords.groupBy("pack").agg(F.count(F.lit(1)).alias("total"), F.bround(F.avg("recommendation"), 0).cast("int").alias("mean_recommendation"), F.bround(F.avg("business"), 0).cast("int").alias("mean_business"), share("recommendation").alias("high_recommendation"), share("business").alias("high_business"))


def infer_profile(seeds: DataFrame, markers: DataFrame, default: str) -> DataFrame:
    """(pack, profile): the profile most of whose markers occur in a pack's seeds; the first in order among equals, a default without hits.

    markers has (profile, at, marker), a parameter table of at most MOST_TEMPLATES rows.
    """
    text = seeds.groupBy("pack").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seed"))), lambda x: x["seed"]), " ")).alias("text"))
    rows = [(r.profile, r.at, r.marker) for r in markers.select("profile", "at", "marker").limit(MOST_TEMPLATES + 1).collect()]
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} markers")
    hits: dict[tuple[int, str], Column] = {}
    for profile, at, marker in sorted(rows, key=lambda r: r[1]):
        hits[(at, profile)] = hits.get((at, profile), F.lit(0)) + F.contains("text", F.lit(marker)).cast("int")
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-at).alias("at"), F.lit(p).alias("profile")) for (at, p), n in hits.items()]))
    return text.select("pack", F.when(best["n"] > 0, best["profile"]).otherwise(default).alias("profile"))
