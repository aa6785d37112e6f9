"""Exact vector search and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.operators.relational import top_per_group

#: Vectors of a block of the corpus and of a block of queries; a pair of blocks is one matrix product.
ROWS, QUERIES = 8192, 512


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """(block, keys, data): unit vectors packed into matrices, rows spread by the hash of their key. Null and zero vectors are left out."""
    count = max(1, -(-df.count() // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(m, axis=1)
        keep = norm > 0
        m = m[keep] / norm[keep][:, None]
        return pd.DataFrame({name: [int(pdf["b"].iloc[0])], "keys": [pdf["k"].to_numpy()[keep].tolist()], "data": [m.tobytes()], "width": [m.shape[1]]})

    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(count)).cast("int").alias("b"))
    return rows.groupBy("b").applyInPandas(pack, f"{name} int, keys array<long>, data binary, width int")


def cosine_search(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, item, similarity, rank): the k items nearest to each query by cosine, itself left out.

    Both sides are packed into blocks of bounded size; every corpus block meets every query block in
    one matrix product, which keeps k items per query, so that only k rows per query and corpus
    block are shuffled. Similarities are rounded to 12 digits and ties go to the smaller key. Vectors
    must have one length.
    """
    q = _blocks(queries, key, vector, QUERIES, "q").select("q", F.col("keys").alias("qkeys"), F.col("data").alias("qdata"))
    c = _blocks(corpus, key, vector, ROWS, "c")
    n = max(1, -(-queries.count() // QUERIES))
    met = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(q, "q")

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                a, b = np.frombuffer(r.qdata).reshape(-1, r.width), np.frombuffer(r.data).reshape(-1, r.width)
                qk, ck = np.asarray(r.qkeys), np.asarray(r.keys)
                sims = np.round(a @ b.T, 12)
                sims[qk[:, None] == ck[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ck, sims.shape), -sims), axis=1)[:, :k]
                got = np.take_along_axis(sims, order, axis=1)
                rows = np.repeat(qk, order.shape[1]), ck[order].ravel(), got.ravel()
                keep = np.isfinite(rows[2])
                yield pd.DataFrame({"query": rows[0][keep], "item": rows[1][keep], "similarity": rows[2][keep]})

    found = met.mapInPandas(nearest, "query long, item long, similarity double")
    return top_per_group(found, ["query"], [F.desc("similarity"), F.col("item")], k)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): the component-wise mean of a group's vectors; means are combined before the shuffle."""
    parts = df.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centroid"))
