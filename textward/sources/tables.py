"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def has_text(col) -> F.Column:
    """True where a text is neither null nor blank (any Unicode white space)."""
    return col.isNotNull() & col.rlike(r"(?U)\S")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a table has fewer partitions than the cluster has cores.

    Work on texts is bound by CPU; a small table in one file would run as one task. Larger tables stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
