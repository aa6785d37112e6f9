"""Rolling totals over trailing periods by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_day(df: DataFrame, entity: str, day: str, version: str, values: Sequence[str]) -> DataFrame:
    """One row per entity and day: the row with the greatest version.

    Rows with a null entity or day are left out. A null version is the oldest; equal versions fall
    back to the greatest values, so exact repeats and ties give one defined row. The maximum is
    combined before the shuffle, so an entity with a large share of the rows sends at most one row
    per day and task.
    """
    best = F.max(F.struct(F.col(version).alias("v"), *[F.col(c).cast("long").alias(f"x{i}") for i, c in enumerate(values)])).alias("best")
    kept = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(best)
    return kept.select("entity", "day", *[F.col(f"best.x{i}").alias(c) for i, c in enumerate(values)])


def dense_days(daily: DataFrame, values: Sequence[str]) -> DataFrame:
    """Adds the missing days between an entity's first and last day, with zeros; null values become zero.

    `had_row` tells days with a row. Each row fills the gap up to the next one, so no calendar is
    joined and the rows stay where the window already put them.
    """
    after = F.lead("day").over(Window.partitionBy("entity").orderBy("day"))
    gaps = daily.withColumn("until", F.coalesce(F.date_sub(after, 1), F.col("day")))
    filled = gaps.select("entity", F.col("day").alias("first"), F.explode(F.sequence("day", "until")).alias("day"), *values)
    own = F.col("day") == F.col("first")
    return filled.select("entity", "day", own.alias("had_row"), *[F.when(own, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c) for c in values])


def trailing_sums(dense: DataFrame, values: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """Adds `<value>_<n>d`, the sum over the n days ending on the day, for each value and period n >= 1.

    Sums of 1, 2, 4, 8, ... days are built by adding the block of half the length that ends half a
    block earlier; a period is the chain of the blocks in its binary form. All steps share one
    sorted partitioning of the entity, and the work is logarithmic in the period. Days before the
    first one count as zero; sums are 64-bit.
    """
    if not periods or min(periods) < 1:
        raise ValueError("periods must be positive")
    order = Window.partitionBy("entity").orderBy("day")

    def earlier(c: str, days: int) -> Column:
        return F.coalesce(F.lag(c, days).over(order), F.lit(0).cast("long"))

    out, levels = dense, max(periods).bit_length()
    for level in range(levels):
        size = 1 << level
        out = out.withColumns({f"_{c}_{size}": F.col(c) if level == 0 else F.col(f"_{c}_{size // 2}") + earlier(f"_{c}_{size // 2}", size // 2) for c in values})
    sums = {}
    for c in values:
        for period in periods:
            total, back = None, 0
            for level in reversed(range(levels)):
                if period >> level & 1:
                    block = f"_{c}_{1 << level}"
                    part = earlier(block, back) if back else F.col(block)
                    total, back = part if total is None else total + part, back + (1 << level)
            sums[f"{c}_{period}d"] = total
    return out.withColumns(sums).drop(*[f"_{c}_{1 << level}" for c in values for level in range(levels)])


def rolling_usage(df: DataFrame, entity: str, day: str, version: str, values: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """Trailing totals per entity and calendar day from first to last day, also for days without a row.

    Columns: entity, day, had_row, the day's values, `<value>_<n>d` totals and `<value>_<n>d_avg`
    (total divided by n). An empty table gives no rows; other columns of the input are ignored.
    """
    totals = trailing_sums(dense_days(latest_per_day(df, entity, day, version, values), values), values, periods)
    return totals.withColumns({f"{c}_{n}d_avg": F.col(f"{c}_{n}d") / F.lit(n) for c in values for n in periods})
