"""Records of the same firm under variant spellings, linked into classes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.names import aligned, first_letters, fits_initials, fold, keys, near, parse_name, parse_slug, parse_url
from lumenry.operators.components import components
from lumenry.sources.stage import staged


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        names = [parse_name(n) for n in pdf["name"]]
        urls = [parse_url(u) for u in pdf["url"]]
        out = pd.DataFrame({"id": pdf["id"], "founded": pdf["founded"], "place": [fold(p or "").strip() for p in pdf["place"]]})
        out["core"], out["trade"], out["initials"], out["alias"] = zip(*names, strict=True) if names else ([], [], [], [])
        out["domain"], label, tenant = zip(*urls, strict=True) if urls else ([], [], [])
        for name, slugs in (("own", label), ("tenant", tenant)):
            parts = [parse_slug(s) for s in slugs]
            out[f"{name}_slug"], out[f"{name}_ini"] = [p[0] for p in parts], [p[2] for p in parts]
        out["fits"] = pd.array([_fits(lab, n) for lab, n in zip(label, names, strict=True)], dtype="boolean")
        yield out


def _fits(label: str, name: tuple[str, str, str, str]) -> bool | None:
    """Whether a domain's label goes with a parsed name: it holds one of its tokens, or a token one slip away; None if the name has no Latin core."""
    core = name[0] if name[0].isascii() else name[3]
    tokens = [t for t in core.split() if len(t) >= 3]
    if not tokens or not label:
        return None
    parts = parse_slug(label)[0].split()
    return any(t in p or near(t, p) for t in tokens for p in (*parts, "".join(parts)))


def described(firms: DataFrame, key: str, name: str, url: str, place: str, founded: str) -> DataFrame:
    """(id, core, trade, rest, initials, slug, place, founded): what a record says about its firm; '' where it says nothing.

    slug is the core of the domain, or of the tenant on a platform: a domain most of whose records
    name a tenant, with different ones among them, and whose label goes with fewer than half of the
    names. These are shares, so that no number of spellings makes a firm's own domain a platform. A name of initials that begin
    with those of the slug takes the slug as its core; the letters over are in `rest`, for the trade.
    """
    raw = firms.select(F.col(key).cast("string").alias("id"), F.col(name).alias("name"), F.col(url).alias("url"), F.col(place).alias("place"), F.coalesce(F.col(founded).cast("string"), F.lit("")).alias("founded"))
    rows = staged(raw.mapInPandas(_parsed, "id string, founded string, place string, core string, trade string, initials string, alias string, domain string, own_slug string, own_ini string, tenant_slug string, tenant_ini string, fits boolean"))
    of = rows.where("domain <> ''").groupBy("domain").agg(F.avg(F.when(F.col("tenant_slug") != "", 1.0).otherwise(0.0)).alias("with_tenant"), F.min(F.nullif(F.col("tenant_slug"), F.lit(""))).alias("least"), F.max("tenant_slug").alias("most"), F.avg(F.when(F.col("fits"), 1.0).when(~F.col("fits"), 0.0)).alias("fitting"))
    platforms = of.where("with_tenant > 0.5 and least <> most and coalesce(fitting, 0) < 0.5").select("domain", F.lit(True).alias("shared"))
    known = rows.join(platforms, "domain", "left")
    slug = F.when(F.col("shared"), F.col("tenant_slug")).otherwise(F.col("own_slug"))
    known = known.withColumn("slug", F.when((slug == "") & (F.col("alias") != ""), F.col("alias")).otherwise(slug)).withColumn("ini", F.when(F.col("shared"), F.col("tenant_ini")).otherwise(F.col("own_ini")))
    told = (F.col("initials") != "") & (F.col("ini") != "") & (F.col("initials").startswith(F.col("ini")) | F.col("initials").startswith(F.reverse("ini")))
    return known.select("id", F.when(told, F.col("slug")).otherwise(F.col("core")).alias("core"), "trade", F.when(told, F.expr("substring(initials, length(ini) + 1)")).otherwise("").alias("rest"), F.when(told, "").otherwise(F.col("initials")).alias("initials"), "slug", "place", "founded")


def _agreed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps candidate pairs of the same firm; `weak` marks those that nothing but the name supports."""
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            if r.founded and r.founded2 and r.founded != r.founded2 or r.place and r.place2 and r.place != r.place2:
                continue
            if r.trade and r.trade2 and r.trade != r.trade2 or not fits_initials(r.core, r.rest, r.core2, r.trade2) or not fits_initials(r.core2, r.rest2, r.core, r.trade):
                continue
            how = aligned(r.core, r.core2) if r.core and r.core2 else ""
            dated, placed = bool(r.founded) and r.founded == r.founded2, bool(r.place) and r.place == r.place2
            wide = any("一" <= c <= "鿿" for c in r.core + r.core2)
            traded = bool(r.trade) and r.trade == r.trade2
            sited = bool(r.slug) and r.slug == r.slug2
            weak = not (dated or placed or sited or traded)
            if wide:
                length = min(len(r.core), len(r.core2))
                ok = (how == "same" and (len(r.core) > 2 or sited or dated)) or how == "prefixed" or (how == "part" and (sited or (dated and traded))) or (sited and (dated or placed or traded) and how == "" and not (r.trade and r.trade2 and not traded) and length <= 2)
                ok = ok or how == "near" and (sited or dated and (traded or length >= 4) or placed and traded and length >= 4)
                weak = weak or how == "near" and not (sited or dated)
            elif r.split and r.split2 and how == "same" and not (dated or placed or sited):
                ok = False  # a name that several firms of this trade bear says nothing
            else:
                ok = how in ("same", "near") or (how == "initial" and (traded or dated or placed or sited)) or how == "close" and dated and traded or how == "part" and traded and (dated or sited)
                if how == "near" and not (dated or placed or sited) and len(r.core) < 8:
                    ok = False
                if not how and dated and (not r.core or not r.core2):
                    one, other = (r.initials, (r.core2, r.trade2)) if not r.core else (r.initials2, (r.core, r.trade))
                    ok = len(one) >= 3 and sorted(one) == first_letters(*other)
            if ok:
                rows.append((r.e, r.e2, weak))
        yield pd.DataFrame(rows, columns=["a", "b", "weak"])


_FIELDS = ("core", "trade", "rest", "initials", "slug", "place", "founded")


def same_firm_links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sure and doubtful edges (a, b) between record ids of the same firm, from the rows of `described`.

    Records that say the same and name a firm become one entity (a star of edges to the least id), and so do those
    with the same full core and trade unless their places or dates differ, in which case place and
    date split them. Entities are candidates if they share a key of the symmetric-delete index and,
    beside it, a date, a place, a slug or a trade, or if one of them says too little for that; or if
    they share a slug and are or meet the entity with most records among those of a trade, place or date there. So
    neither a key nor a slug that many firms share pairs them all. Candidates are judged by the
    assignment of their tokens, their trades, places and dates; a pair that nothing but a name
    without trade supports is doubtful.
    """
    long = F.when(F.col("core").rlike("[一-鿿]"), F.length("core") > 2).otherwise(F.col("core") != "")
    full = records.where(long & (F.col("trade") != ""))
    one = lambda c: F.max(F.when(F.col(c) != "", F.col(c)))
    firm = full.groupBy("core", "trade").agg((F.count_distinct(F.nullif(F.col("place"), F.lit(""))) <= 1).alias("one_place"), (F.count_distinct(F.nullif(F.col("founded"), F.lit(""))) <= 1).alias("one_date"))
    split = records.join(firm, ["core", "trade"], "left")
    merged = F.coalesce(F.col("one_place") & F.col("one_date"), F.lit(False))
    group = split.withColumn("g", F.when((F.col("core") == "") & (F.col("initials") == ""), F.concat(F.lit("\u0002"), "id")).when(merged, F.concat_ws("\u0001", "core", "trade")).otherwise(F.concat_ws("\u0001", *_FIELDS)))
    entity = group.groupBy("g").agg(F.min("id").alias("e"), F.count(F.lit(1)).alias("n"), F.bool_or(~F.coalesce(F.col("one_place") & F.col("one_date"), F.lit(True))).alias("split"), *[F.coalesce(one(c), F.lit("")).alias(c) for c in _FIELDS])
    entity = staged(entity)
    stars = group.select("id", "g").join(entity.select("g", "e"), "g").select(F.col("id").alias("a"), F.col("e").alias("b"))
    slugs = group.where("slug <> ''").join(entity.select("g", "e"), "g").select("e", "slug").distinct()

    @F.pandas_udf("array<string>")
    def listed(core: pd.Series, trade: pd.Series, founded: pd.Series, initials: pd.Series) -> pd.Series:
        return pd.Series([keys(c, t, f) if c else [f"n:{''.join(sorted(i))}|{f}"] if f and len(i) >= 3 else [] for c, t, f, i in zip(core, trade, founded, initials, strict=True)])

    index = entity.select("e", F.explode(listed("core", "trade", "founded", "initials")).alias("key"))
    shared = staged(index.join(index.groupBy("key").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("key"), "key", "left_semi"))
    said = shared.join(entity.select("e", "trade", "place", "founded", "slug", "split"), "e")
    same = lambda c, kind: F.when(c != "", F.concat(F.lit(kind), c))
    beside = F.array_compact(F.array(same(F.col("founded"), "f"), same(F.col("place"), "p"), same(F.col("slug"), "s"), F.when(~F.col("split"), same(F.col("trade"), "t"))))
    backed = said.select("e", "key", "place", "founded", F.explode(beside).alias("beside"))
    partner = backed.select(*[F.col(c).alias(f"{c}2") for c in ("e", "place", "founded")], "key", "beside")
    apart = lambda c: (F.col(c) != "") & (F.col(f"{c}2") != "") & (F.col(c) != F.col(f"{c}2"))
    by_name = backed.join(partner, ["key", "beside"]).where((F.col("e") < F.col("e2")) & ~apart("place") & ~apart("founded")).select("e", "e2")
    blanks = sum((F.when(F.col(c) == "", 1).otherwise(0) for c in ("trade", "place", "founded")), F.lit(0))
    vague = said.where((blanks >= 2) & ~F.col("split")).select("e", "key", "trade", "place", "founded")
    other = said.select("key", *[F.col(c).alias(f"{c}2") for c in ("e", "trade", "place", "founded")])
    by_vague = vague.join(other, "key").where((F.col("e") != F.col("e2")) & ~apart("trade") & ~apart("place") & ~apart("founded")).select(F.least("e", "e2").alias("e"), F.greatest("e", "e2").alias("e2"))
    sited = slugs.join(entity.select("e", "trade", "place", "founded", "n"), "e")
    kinds = F.array_compact(F.array(F.concat(F.lit("t"), "trade"), same(F.col("place"), "p"), same(F.col("founded"), "f")))
    placed = sited.select("e", "slug", "n", F.explode(kinds).alias("kind"))
    centres = placed.groupBy("slug", "kind").agg(F.max_by("e", F.struct("n", "e")).alias("e2")).select("slug", "e2").distinct()
    by_slug = sited.select("e", "slug").join(centres, "slug").where("e <> e2").select(F.least("e", "e2").alias("e"), F.greatest("e", "e2").alias("e2"))
    dated = entity.where((F.col("trade") != "") & (F.col("founded") != "") & F.col("core").rlike("^[一-鿿]")).select("e", "core", F.concat_ws("|", F.substring("core", 1, 1), "trade", "founded").alias("key"))
    by_part = dated.where(F.length("core") == 2).join(dated.select(F.col("e").alias("e2"), "key"), "key").where("e <> e2").select(F.least("e", "e2").alias("e"), F.greatest("e", "e2").alias("e2"))
    pairs = by_name.unionByName(by_vague).unionByName(by_slug).unionByName(by_part).distinct()
    left = entity.select("e", "split", *_FIELDS)
    right = entity.select(F.col("e").alias("e2"), F.col("split").alias("split2"), *[F.col(c).alias(f"{c}2") for c in _FIELDS])
    met = pairs.join(left, "e").join(right, "e2")
    judged = staged(met.mapInPandas(_agreed, "a string, b string, weak boolean"))
    strong = judged.where("not weak").select("a", "b").unionByName(stars).where("a <> b").distinct()
    return strong, judged.where("weak").select("a", "b")


def firm_links(records: DataFrame) -> DataFrame:
    """(node, component): the classes of the sure links, joined by doubtful ones that leave no choice.

    A doubtful link holds if neither of its ends has doubtful links to two different classes.
    """
    strong, weak = same_firm_links(records)
    sure = staged(components(strong))
    weak = staged(weak)
    of = lambda c: weak.join(sure.select(F.col("node").alias(c), F.col("component").alias(f"{c}c")), c, "left")
    named = of("a").join(of("b").select("a", "b", "bc"), ["a", "b"]).select("a", "b", F.coalesce("ac", "a").alias("ac"), F.coalesce("bc", "b").alias("bc")).where("ac <> bc")
    ends = named.select(F.explode(F.array(F.struct(F.col("ac").alias("x"), F.col("bc").alias("y")), F.struct(F.col("bc").alias("x"), F.col("ac").alias("y")))).alias("s")).select("s.*").distinct()
    torn = ends.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x")
    held = ends.join(torn, "x", "left_anti").join(torn.withColumnRenamed("x", "y"), "y", "left_anti").where("x < y")
    joined = held.select("y", F.col("x").alias("least"))
    alone = held.select(F.explode(F.array("x", "y")).alias("node"), F.col("x").alias("least"))
    all_ = sure.unionByName(alone.select("node", F.col("node").alias("component"))).distinct()
    return all_.join(joined, F.col("component") == F.col("y"), "left").select("node", F.coalesce("least", "component").alias("component")).distinct()


def firm_classes(firms: DataFrame, key: str = "id", name: str = "name", url: str = "url", place: str = "headquarters", founded: str = "founded_date") -> DataFrame:
    """(id, firm) for every record: the least id of its firm's class, and its own id if it is alone.

    Rows with a null id are left out; of repeated ids one row is used. Names and URLs may be null.
    """
    unique = firms.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[F.col(c) for c in (name, url, place, founded)])).alias("r")).select(key, "r.*")
    records = staged(described(unique, key, name, url, place, founded))
    classes = firm_links(records)
    return records.select("id").join(classes.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("firm"))


def variant_pairs(classes: DataFrame) -> DataFrame:
    """(id_a, id_b) for all ids of one firm, id_a < id_b: k(k-1)/2 rows for k ids, as the result is defined."""
    many = classes.join(classes.groupBy("firm").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("firm"), "firm", "left_semi")
    return many.select("firm", F.col("id").alias("id_a")).join(many.select("firm", F.col("id").alias("id_b")), "firm").where("id_a < id_b").select("id_a", "id_b")
