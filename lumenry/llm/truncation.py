"""Texts that were cut off by field limits or in transfer."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.llm.endings import bare_end, end_likelihood, ending_counts, is_short, last_grams
from lumenry.sources.stage import staged

#: Lengths a store may have limited: of the text in an encoding, or with its marks escaped or line ends converted.
MEASURES: dict[str, Callable[[str], int]] = {
    "chars": len,
    "utf16": lambda t: len(t.encode("utf-16-le", "replace")) // 2,
    "utf8": lambda t: len(t.encode("utf-8", "replace")),
    "utf8_next": lambda t: len(t.encode("utf-8", "replace")) + 1,
    "utf8_next2": lambda t: len(t.encode("utf-8", "replace")) + 2,
    "utf8_next3": lambda t: len(t.encode("utf-8", "replace")) + 3,
    "html": lambda t: len(html.escape(t)),
    "html_text": lambda t: len(html.escape(t, quote=False)),
    "json": lambda t: len(json.dumps(t, ensure_ascii=False)) - 2,
    "json_ascii": lambda t: len(json.dumps(t)) - 2,
    "crlf": lambda t: len(t) + t.count("\n"),
    "crlf_utf8": lambda t: len(t.encode("utf-8", "replace")) + t.count("\n"),
}
#: The byte measures that leave room for a character that no longer fitted; they serve no other texts.
_PARTIAL = {"utf8_next": 1, "utf8_next2": 2, "utf8_next3": 3}
#: A limit shows where the texts that surely were cut pile up at one length: by chance, at the rate of the lengths within NEARBY, so many
#: would come with a logarithmic probability below CHANCE, and they are TIMES as many as that rate.
CHANCE, TIMES, NEARBY = -13.8, 6, 20
#: Below the first likelihood of an end a text is cut wherever it stops; below the second if it fills a limit.
UNLIKELY, CERTAIN = 0.15, 0.9
_SCHEMA = "key long, source string, state string, grams array<long>, measures array<struct<measure:string,size:int>>"


def _inspect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows, bares = [], []
        for key, source, text in zip(pdf["key"], pdf["source"], pdf["text"], strict=True):
            bare, marked, signs = bare_end(text or "")
            sign = "�" in signs or "[" in signs or signs[:1] in ("<", "&") or signs[-1:].isalpha()
            state = "" if not bare or (marked and not sign) else "sign" if sign else "short" if is_short(bare) else "bare"
            sizes = [(m, f(bare)) for m, f in MEASURES.items()] if state else []
            if sizes and bare.isascii():
                sizes = [(m, n) for m, n in sizes if m not in _PARTIAL]
            bares.append(bare if state else "")
            rows.append((key, source, state, [{"measure": "utf8" if m in _PARTIAL else m, "size": n} for m, n in sizes]))
        out = pd.DataFrame(rows, columns=["key", "source", "state", "measures"])
        yield out.assign(grams=last_grams(bares))[["key", "source", "state", "grams", "measures"]]


def _inspected(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, state, grams, measures) of texts without a final mark: state is `sign`, `bare`, or `short` (no longer than a title)."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return rows.mapInPandas(_inspect, _SCHEMA).where("state <> ''")


def length_limits(sure: DataFrame) -> DataFrame:
    """(source, measure, size, n): lengths at which texts of a source that surely were cut pile up, from rows (source, measures).

    Every such text is counted under every measure; only (source, measure, length) counts are
    shuffled, so a source with most of the texts costs one row per task and length. The window runs
    over lengths, not texts. The test is the same for small and large sources (CHANCE, TIMES).
    """
    sized = sure.select("source", F.explode(F.array_distinct("measures")).alias("m")).groupBy("source", "m.measure", "m.size").agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("source", "measure").orderBy("size").rangeBetween(-NEARBY, NEARBY)
    rate = (F.sum("n").over(around) - F.col("n") + 1) / (2 * NEARBY)
    odds = -F.col("rate") + F.col("n") * (1 + F.log(F.col("rate") / F.col("n")))  # a bound of the tail of the Poisson distribution
    return sized.withColumn("rate", rate).where((F.col("n") >= TIMES * F.col("rate")) & (odds < CHANCE)).select("source", "measure", "size", "n")


def truncated(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Documents cut before their end: columns key, source, reason (`sign`, `ending` or `limit`), reasons (all that hold).

    `sign`: a broken character, tag or entity, or a bracketed sign such as [more], at the end.
    `ending`: it stops where the corpus's sentences hardly ever stop. `limit`: it fills a length limit
    of its source under some encoding and has no certain end; limits are found from the texts that
    surely were cut. A final mark, dots after a complete sentence, or a limit's length alone make no
    case: a text that fills a limit and ends in a mark may as well be complete. A text no longer than
    a title, whose end says nothing, is cut only by a sign or at a limit. Null and empty texts are
    complete. Sentence ends are counted over all texts; lengths do not matter otherwise.
    """
    seen = staged(_inspected(docs, key, source, text))
    likely = end_likelihood(seen.select("key", "grams"), ending_counts(docs, text))
    q = F.coalesce("likelihood", F.lit(0.0))
    ending = (F.col("state") == "bare") & F.col("likelihood").isNotNull() & (q < UNLIKELY)
    judged = staged(seen.drop("grams").join(likely, "key", "left").withColumn("sign", F.col("state") == "sign").withColumn("ending", ending))
    limits = length_limits(judged.where("sign or ending")).select("source", "measure", "size")
    each = judged.select("key", "source", F.explode("measures").alias("m")).select("key", "source", "m.measure", "m.size")
    full = each.join(limits, ["source", "measure", "size"], "left_semi").select("key").distinct().withColumn("full", F.lit(True))
    reasons = F.array(F.when(F.col("sign"), "sign"), F.when(F.col("ending"), "ending"), F.when(F.col("full") & (q < CERTAIN), "limit"))
    told = judged.join(full, "key", "left").withColumn("reasons", F.array_compact(reasons)).where("size(reasons) > 0")
    return told.select("key", "source", F.element_at("reasons", 1).alias("reason"), "reasons")


def share_per_source(docs: DataFrame, cut: DataFrame, source: str = "source") -> DataFrame:
    """Per source: texts, texts cut, and the share of them; a null source counts as ''."""
    all_ = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_texts"))
    some = cut.groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    n_cut = F.coalesce("n_cut", F.lit(0))
    return all_.join(some, "source", "left").select("source", "n_texts", n_cut.alias("n_cut"), F.round(n_cut / F.col("n_texts"), 6).alias("share"))
