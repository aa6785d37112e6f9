"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.sources.stage import staged

#: Rounds after which a graph is given up; each round at least halves long chains.
MOST_ROUNDS = 40


def _digest(links: DataFrame) -> tuple:
    """Number and combined hash of the links; equal sets have equal digests."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges; component is the least node of it.

    Large-star and small-star steps in turn: each links the neighbours of a node to the least of
    them, until nothing changes. Minima are combined before the shuffle, a hot node's neighbours
    are joined to one row, and every round is written to the checkpoint folder, so that plans stay
    short and lost executors cost one round. Null ends and loops are left out; an empty graph gives
    no rows.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links = staged(links)
    last = None
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.withColumnRenamed("m", "v")).distinct()
        links = staged(small)
        now = _digest(links)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    found = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = links.select(F.col("v").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return found.unionByName(roots)
