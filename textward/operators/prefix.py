"""Ranks and running sums inside groups of any size, without one task per group.

A window over a whole group would put a hot group into one task. Here each group is cut
into slices by the leading bits of a uniform order key; windows run inside slices, and the
offsets of the slices come from a window over the slice totals (one row per group and slice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_prefix(
    df: DataFrame,
    groups: list[str],
    order: str,
    tie: list[str],
    value: str | None = None,
    slices: int = 64,
) -> DataFrame:
    """Add ``rank`` (0-based) and, with ``value``, ``before`` (sum of earlier values).

    ``order`` is a BIGINT spread uniformly over 0 .. 2**62-1 (a hash); ``tie`` makes the
    order total. ``slices`` should grow with the largest group: rows per slice stay bounded.
    Null values count as 0; null groups form a group of their own.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / F.lit(2**62 // slices)).cast("int"))
    aggs = [F.count(F.lit(1)).alias("_n")]
    if value:
        aggs.append(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_v"))
    totals = sliced.groupBy(*groups, "_slice").agg(*aggs)
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_v0")] if value else []),
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy(order, *tie)
    ranked = sliced.withColumn("_rank", F.row_number().over(inside) - 1)
    if value:
        ranked = ranked.withColumn(
            "_before",
            F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
    on = F.col("_slice") == F.col("_s")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = ranked.join(offsets, on)
    out = joined.withColumn("rank", F.col("_rank") + F.col("_n0"))
    if value:
        out = out.withColumn("before", F.col("_before") + F.col("_v0"))
    return out.drop("_slice", "_s", "_n0", "_rank", *[f"_g{i}" for i in range(len(groups))], *(["_v0", "_before"] if value else []))


def order_hash(*cols) -> F.Column:
    """A uniform order key for :func:`with_prefix`."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)
