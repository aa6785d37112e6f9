"""Relational building blocks: filters, lookups, roll-ups, per-group picks, pages."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.sources.stage import staged


def where_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters for the arguments that are given; None and '' filter nothing. Predicates reach the scan."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v not in (None, "")), df)


def matches_any(pattern: str, columns: Sequence[Column], arrays: Sequence[Column] = ()) -> Column:
    """Case-insensitive substring search over texts and elements of arrays; `%` and `_` stay wildcards, null matches nothing."""
    like = f"%{pattern}%"
    tests = [F.coalesce(c.ilike(like), F.lit(False)) for c in columns] + [F.coalesce(F.exists(a, lambda x: x.ilike(like)), F.lit(False)) for a in arrays]
    return reduce(Column.__or__, tests)


def one_of(column: str, value: str, allowed: Sequence[str]) -> Column:
    """Equality with a checked value; ValueError for a value that is not allowed."""
    if value not in allowed:
        raise ValueError(f"{column}: {value!r} is none of {', '.join(allowed)}")
    return F.col(column) == value


def string_list(c: Column) -> Column:
    """The strings of a JSON list; empty for null, invalid or other JSON."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def missing_fields(required: Mapping[str, Column]) -> Column:
    """Names, in order, of the fields whose condition of being present does not hold."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in required.items()]), lambda x: x.isNotNull())


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest (order, columns); nulls count as least, and a whole tie is one row.

    A maximum of structs, combined before the shuffle, so that no key's rows are sorted together.
    """
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}") for c in columns])


def enum_counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(value, n) for each listed value, also those that do not occur; one pass of conditional counts."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(f"c{i}") for i, v in enumerate(values)])
    pairs = F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"c{i}").alias("n")) for i, v in enumerate(values)])
    return counts.select(F.inline(pairs))


def calendar(df: DataFrame, day: str, start: str, days: int, series: Sequence[str]) -> DataFrame:
    """Counts per day and series over a run of days, 0 where nothing happened.

    df has (series, day). The calendar has `days` rows, so its broadcast is bounded.
    """
    counted = df.where(F.col(day).between(F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), days - 1))).groupBy(day).pivot("series", list(series)).count()
    grid = df.sparkSession.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias(day))
    return grid.join(F.broadcast(counted), day, "left").select(day, *[F.coalesce(s, F.lit(0)).alias(s) for s in series])


def local_time(ts: Column, zone: str, default: str) -> Column:
    """A time without zone, read as UTC, on the clocks of a zone; the default serves for a zone that is not known."""
    try:
        ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError):
        zone = default
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """One page of an ordered list; number and size are brought into range, and the order must end in a unique key."""
    number, size = max(1, number), min(max(1, size), most)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key by an order that ends in a unique key; Spark keeps k per task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of both, the one of each key with the greatest order value; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [order, "_new"], [c for c in old.columns if c not in keys])


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and the rows of new whose key it lacks; repeats within new count once."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those rows of old whose key does not occur in new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def follow_pointers(df: DataFrame, node: str, target: str) -> DataFrame:
    """(node, root): where each node's chain of targets ends; a node in a cycle ends at the cycle's least node.

    Pointers are doubled until none moves, so a chain of n takes about log2 n joins. A node that is
    still on its way after as many hops as there are nodes runs into a cycle: 2^k hops, at least that
    many, lead onto the cycle, and from there all of it has been met. A null target, or one that is
    no node, ends a chain. A node must have one row.
    """
    nodes = df.select(F.col(node).alias("n"), F.col(target).alias("t"))
    known = nodes.select(F.col("n").alias("t"), F.lit(True).alias("k"))
    # t is 2^k hops on, or the end of the chain; low the least node of the 2^k targets met on the way
    hops = staged(nodes.join(known, "t", "left").select("n", F.when(F.col("k"), F.col("t")).alias("t"), F.when(F.col("k"), F.col("t")).alias("low")).withColumn("more", F.col("t").isNotNull()))
    reach, moving = 1, hops.where("more").count()
    total = hops.count() if moving else 0
    while moving and reach < total:
        after = hops.select(F.col("n").alias("t"), F.col("t").alias("t2"), F.col("low").alias("low2"), F.lit(True).alias("k"))
        hops = staged(hops.join(after, "t", "left").select("n", F.coalesce("t2", "t").alias("t"), F.least("low", "low2").alias("low"), F.col("t2").isNotNull().alias("more")))
        reach, moving = reach * 2, hops.where("more").count()
    if not moving:
        return hops.select(F.col("n").alias("node"), F.coalesce("t", "n").alias("root"))
    ends = hops.select(F.col("n").alias("t"), F.col("t").isNotNull().alias("ring"), F.col("low").alias("least"))
    return hops.join(ends, "t", "left").select(F.col("n").alias("node"), F.when(F.col("ring"), F.col("least")).otherwise(F.coalesce("t", "n")).alias("root"))


def tagged_union(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(key, match_types): each key with the sorted names of the parts it occurs in; an OR of joins without a theta join."""
    tagged = [df.select(key).distinct().withColumn("kind", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.array_sort(F.collect_set("kind")).alias("match_types"))


def backfill(first: DataFrame, second: DataFrame, keys: Sequence[str], item: str, order: str, k: int) -> DataFrame:
    """Up to k items per key: those of the first ranking, then those of the second it lacks. Order values rise from the best."""
    both = first.select(*keys, item, F.lit(0).alias("source"), F.col(order).alias("o")).unionByName(second.select(*keys, item, F.lit(1).alias("source"), F.col(order).alias("o")))
    best = both.groupBy(*keys, item).agg(F.min(F.struct("source", "o")).alias("b"))
    return top_per_group(best, keys, [F.col("b.source"), F.col("b.o"), F.col(item)], k).select(*keys, item, F.col("b.source").alias("source"), "rank")


def word_windows(c: Column, size: int = 400, overlap: int = 50) -> Column:
    """Overlapping windows of words; a text whose words run past a window's step begins another one."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))
