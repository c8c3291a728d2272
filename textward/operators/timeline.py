"""Places of rows in the timeline of their key, for keys of any size.

A window over a whole key would put a hot key into one task. Here timelines are cut into slices of
time: windows run inside slices, and what a slice needs to know of earlier ones comes from a window
over one row per key and slice. All rows go through one shuffle, by key and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice.
SLICE = 60


def micros(col: str | Column) -> Column:
    """Microseconds of a time, with or without zone (the session's zone should be UTC)."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def places(df: DataFrame, keys: list[str], ts: str, tie: str, fresh_after: int | None = None, seconds: int = SLICE) -> DataFrame:
    """Add ``rank`` (1, ... by ts and tie within the keys); with ``fresh_after`` also ``life`` (0, ...) and ``turn`` (1, ...).

    A row ``fresh_after`` seconds or more after the row before it starts a new life. Rows with a
    null key or time are left out; rows that agree in ts and tie come in any order.
    """
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, ts))).withColumn("_us", micros(ts))
    rows = rows.withColumn("_slice", F.floor(F.col("_us") / (seconds * 1_000_000)).cast("long"))
    by = [*keys, "_slice"]
    inside = Window.partitionBy(*by).orderBy("_us", tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max("_us").alias("_last"))
    offsets = sums.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.lag("_last").over(earlier).alias("_previous"))
    rows = rows.withColumn("_rank", F.row_number().over(inside)).withColumn("_lag", F.lag("_us").over(inside)).join(offsets, by)
    rows = rows.withColumn("rank", F.col("_rank") + F.col("_n0"))
    if fresh_after is None:
        return rows.drop("_us", "_slice", "_rank", "_lag", "_n0", "_previous")
    gap = F.col("_us") - F.coalesce("_lag", "_previous")
    rows = rows.withColumn("_fresh", F.when(gap >= fresh_after * 1_000_000, 1).otherwise(0)).drop("_rank", "_lag", "_n0", "_previous")
    start = F.when(F.col("_fresh") == 1, F.col("rank"))
    lives = rows.groupBy(*by).agg(F.sum("_fresh").alias("_f"), F.max(start).alias("_s"))
    carried = lives.select(*by, F.coalesce(F.sum("_f").over(before), F.lit(0)).alias("_f0"), F.coalesce(F.max("_s").over(before), F.lit(1)).alias("_s0"))
    rows = rows.withColumn("_f", F.sum("_fresh").over(upto)).withColumn("_s", F.max(start).over(upto)).join(carried, by)
    rows = rows.withColumn("life", F.col("_f") + F.col("_f0")).withColumn("turn", F.col("rank") - F.coalesce("_s", "_s0") + 1)
    return rows.drop("_us", "_slice", "_fresh", "_f", "_s", "_f0", "_s0")
