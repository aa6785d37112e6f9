"""Scores, bands and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_score(seed: Column, dimension: Column, keyword: Column, base: Column | int, spread: int) -> Column:
    """A repeatable score in 35..99: the base plus a remainder of the MD5 of the three texts."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", seed, dimension, keyword)), 1, 8), 16, 10).cast("long")
    base = F.lit(base) if isinstance(base, int) else base
    return F.greatest(F.lit(35), F.least(F.lit(99), base + F.pmod(digest, F.lit(spread)))).cast("int")


def weighted_score(scores: dict[str, Column], weights: dict[str, float], default: dict[str, float]) -> Column:
    """Weighted mean rounded half to even; negative weights count as 0, and the default serves if no weight is left."""
    own = {k: max(0.0, float(weights.get(k) or 0)) for k in scores}
    own = own if sum(own.values()) > 0 else default
    total = sum(own.values())
    return F.bround(sum((scores[k] * F.lit(own[k] / total) for k in scores), F.lit(0.0)), 0).cast("int")


def band(score: Column, steps: tuple[tuple[float, str], ...], below: str) -> Column:
    """The name of the first step, from the top, that a score reaches; null for a null score."""
    out = F.lit(below)
    for least, name in sorted(steps):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def clamp_percent(value: Column) -> Column:
    """A number, or text of one, as an integer in 0..100, rounded half to even; null for other values."""
    number = F.bround(value.try_cast("double")).cast("int")
    return F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), number)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; null if one is null or zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def lexical_score(terms: Column, name: Column, category: Column, tags: Column, blob: Column, certified: Column, geo: Column) -> Column:
    """Match score of search terms with an organisation's lower-case fields.

    Per term: name equal 60 or containing it 34; category 26 or 18; each tag 20 or, if one contains
    the other, 12; anywhere in the blob 5. Certified adds 2, and a score that is not 0 adds a 25th
    of it, at most 4. A null field matches nothing.
    """
    name, category, blob = (F.coalesce(c, F.lit("")) for c in (name, category, blob))
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    per_tag = lambda t: F.aggregate(tags, F.lit(0.0), lambda s, g: s + F.when(t == g, 20.0).when(F.contains(g, t) | F.contains(t, g), 12.0).otherwise(0.0))
    per_term = lambda t: F.when(t == name, 60.0).when(F.contains(name, t), 34.0).otherwise(0.0) + F.when(t == category, 26.0).when(F.contains(category, t), 18.0).otherwise(0.0) + per_tag(t) + F.when(F.contains(blob, t), 5.0).otherwise(0.0)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + per_term(t)) + F.when(F.coalesce(certified, F.lit(False)), 2.0).otherwise(0.0) + F.when(geo.isNotNull() & (geo != 0), F.least(geo / 25.0, F.lit(4.0))).otherwise(0.0)
