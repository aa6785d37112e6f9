"""References to records that do not exist, found with bitmaps over dictionary-encoded keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenry.functions.refs import is_uuid_key, ref_key

#: Keys a bucket of the dictionary should hold, about half a bitmap's 32768 bits.
BUCKET_KEYS = 16_384
#: Rows per distinct key assumed of child tables when the buckets are sized. If every row had its own key,
#: a bucket would hold this many times BUCKET_KEYS; its codes then spread over further bitmaps.
ROWS_PER_KEY = 16
#: Period of rows without a time; every month is greater.
NO_PERIOD = -1


@dataclass(frozen=True)
class Reference:
    """One reference column: child rows (id, reference, time) that point at the ids of a parent table."""

    child_table: str
    ref_column: str
    child: DataFrame
    parent_table: str
    parent: DataFrame
    child_id: str = "id"
    parent_id: str = "id"
    time: str = "created_at"


def _month(ts: Column) -> Column:
    return F.coalesce(F.year(ts) * 12 + F.month(ts) - 1, F.lit(NO_PERIOD))


def _and_not(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bits of the children of each period that no parent of an earlier period covers, decoded.

    ref is -1 for the parents' bitmaps. A child without a period is held against all parents.
    """
    bits = np.stack([np.unpackbits(np.frombuffer(b, dtype=np.uint8), bitorder="little") for b in pdf["bits"]]).astype(bool)
    refs, periods = pdf["ref"].to_numpy(), pdf["period"].to_numpy()
    parents = np.flatnonzero(refs == -1)
    parents = parents[np.argsort(periods[parents], kind="stable")]
    covered = np.logical_or.accumulate(bits[parents], axis=0) if len(parents) else np.zeros((0, bits.shape[1]), bool)
    everyone = covered[-1] if len(parents) else np.zeros(bits.shape[1], bool)
    out = []
    for i in np.flatnonzero(refs != -1):
        before = np.searchsorted(periods[parents], periods[i], side="left") if periods[i] != NO_PERIOD else len(parents)
        left = np.flatnonzero(bits[i] & ~(covered[before - 1] if before else np.zeros_like(everyone)))
        out.append(pd.DataFrame({"ref": refs[i], "period": periods[i], "bit": left, "missing": ~everyone[left]}))
    first = pdf.iloc[0]
    found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"ref": [], "period": [], "bit": [], "missing": []})
    return found.assign(dom=first["dom"], bucket=first["bucket"], slab=first["slab"])[["dom", "bucket", "slab", "ref", "period", "bit", "missing"]]


def orphan_references(references: Sequence[Reference]) -> DataFrame:
    """Every child row whose reference has no parent (`missing`) or a parent created after it (`late`).

    Columns child_table, ref_column, child_id, kind, period (yyyy-MM of the child, or `unknown`).
    References compare as in ref_key; no reference gives no row, text that is no UUID is missing.
    A child or parent without a time is never late; of repeated parents the earliest time counts.
    Exact repeats come out once. Empty children give no rows; with an empty parent all are missing.

    Keys are reduced to one row per (column, key, month) before they are shuffled, then put into
    buckets by hash; the dense rank within a bucket is the key's code. Codes become bitmaps per
    bucket, column and month. A child bitmap AND NOT the bitmap of the parents of earlier months
    leaves the missing keys and the few that may be late; those are decoded, joined to the child
    rows and, if late, held against the exact time. AQE splits a hot key in that join: the decoded
    side has one row per key and month.
    """
    parent_names = list(dict.fromkeys(r.parent_table for r in references))
    children, parents, sizes = [], [], dict.fromkeys(parent_names, 0)
    for i, r in enumerate(references):
        dom = parent_names.index(r.parent_table)
        children.append(r.child.select(F.lit(i).alias("ref"), F.lit(dom).alias("dom"), ref_key(F.col(r.ref_column)).alias("key"), _month(F.col(r.time)).alias("period"), F.col(r.time).alias("at"), F.col(r.child_id).alias("child_id")).where("key is not null"))
        sizes[r.parent_table] += r.child.count() // ROWS_PER_KEY
    for dom, name in enumerate(parent_names):
        r = next(x for x in references if x.parent_table == name)
        parents.append(r.parent.select(F.lit(dom).alias("dom"), ref_key(F.col(r.parent_id)).alias("key"), F.col(r.time).alias("at")).where(F.col("key").isNotNull() & is_uuid_key(F.col("key"))))
        sizes[name] += r.parent.count()
    buckets = F.element_at(F.array(*[F.lit(max(1, -(-sizes[n] // BUCKET_KEYS))) for n in parent_names]), F.col("dom") + 1)
    rows = reduce(DataFrame.unionByName, children)
    seen = rows.groupBy("dom", "key", "ref", "period").agg(F.lit(None).cast("timestamp_ntz").alias("born"))
    born = reduce(DataFrame.unionByName, parents).groupBy("dom", "key").agg(F.min(F.col("at").cast("timestamp_ntz")).alias("born"))
    born = born.select("dom", "key", F.lit(-1).alias("ref"), _month(F.col("born")).alias("period"), "born")
    coded = seen.unionByName(born).withColumn("bucket", F.pmod(F.xxhash64("key"), buckets))
    coded = coded.withColumn("code", F.dense_rank().over(Window.partitionBy("dom", "bucket").orderBy("key")).cast("long"))
    coded = coded.withColumn("slab", F.bitmap_bucket_number("code")).withColumn("bit", F.bitmap_bit_position("code"))
    bitmaps = coded.groupBy("dom", "bucket", "slab", "ref", "period").agg(F.bitmap_construct_agg("bit").alias("bits"))
    left = bitmaps.groupBy("dom", "bucket", "slab").applyInPandas(_and_not, "dom int, bucket long, slab long, ref int, period int, bit long, missing boolean")
    words = coded.groupBy("dom", "bucket", "slab", "bit").agg(F.first("key").alias("key"), F.max("born").alias("born"))
    orphans = left.join(words, ["dom", "bucket", "slab", "bit"]).select("ref", "key", "period", "missing", "born")
    found = rows.join(orphans, ["ref", "key", "period"]).where(F.col("missing") | (F.col("at") < F.col("born")))
    label = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("ref") + 1)
    return found.select(
        label([r.child_table for r in references]).alias("child_table"),
        label([r.ref_column for r in references]).alias("ref_column"),
        F.col("child_id").cast("string").alias("child_id"),
        F.when(F.col("missing"), "missing").otherwise("late").alias("kind"),
        F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("period"),
    ).distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan rows per child table, column, kind and period."""
    return orphans.groupBy("child_table", "ref_column", "kind", "period").agg(F.count(F.lit(1)).alias("n_rows"))
