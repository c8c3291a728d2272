"""Reports over hits and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits_rollup(hits: DataFrame, signatures: DataFrame) -> DataFrame:
    """category, signature_id, hits, requests: by signature, by category and in all (nulls for totals)."""
    rows = hits.join(signatures.select("signature_id", "category"), "signature_id")
    return rows.rollup("category", "signature_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("request_id").alias("requests"))


def top_signatures(hits: DataFrame, limit: int = 20) -> DataFrame:
    """The signatures with most hits (a top-k report), ties by id."""
    return hits.groupBy("signature_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("score")).orderBy(F.desc("hits"), "signature_id").limit(limit)


def decision_rates(decided: DataFrame, *by: str) -> DataFrame:
    """by, requests, blocked, flagged, block_rate."""
    rows = decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum((F.col("decision") == "block").cast("long")).alias("blocked"),
        F.sum((F.col("decision") == "flag").cast("long")).alias("flagged"),
    )
    return rows.withColumn("block_rate", F.col("blocked") / F.col("requests"))
