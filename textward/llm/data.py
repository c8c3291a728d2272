"""The tables of the training-data operators, one row per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm.lookalike import counts_key, member_counts
from textward.sources.tables import has_text, spread, table


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery of a request with text: request_id, text, source, received_at.

    Deliveries of one request repeat its text; results are reduced to one row per request
    where the rows are narrow.
    """
    df = spread(table(spark, folder, "scan_requests"))
    return df.where(F.col("request_id").isNotNull() & has_text(F.col("text"))).select("request_id", "text", "source", "received_at")


def patterns(spark: SparkSession, folder: str) -> DataFrame:
    """pattern_id and all its phrases in one text, one phrase a line (patterns with phrases only)."""
    df = table(spark, folder, "signature_patterns").where("size(reference_phrases) > 0")
    return df.select("pattern_id", F.array_join("reference_phrases", "\n").alias("text")).where(has_text(F.col("text")))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Requests and patterns together: kind (0 request, 1 pattern), id, text."""
    a = requests(spark, folder).select(F.lit(0).alias("kind"), F.col("request_id").alias("id"), "text")
    b = patterns(spark, folder).select(F.lit(1).alias("kind"), F.col("pattern_id").alias("id"), "text")
    return a.unionByName(b)


def kind_name(col) -> F.Column:
    """record_kind of :func:`records`."""
    return F.when(col == 0, F.lit("request")).otherwise(F.lit("pattern"))


def form_key(spark: SparkSession, folder: str) -> tuple:
    """Corpus frequencies of look-alike class members over all requests and patterns."""
    return counts_key(member_counts(records(spark, folder), "text"))


def small(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a table of parameters; a ValueError if it has more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of parameters has more than {most} rows")
    return rows
