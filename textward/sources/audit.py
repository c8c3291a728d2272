"""Audit events: JSON-lines sink, queries, and log events of scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories of audit events.
CATEGORIES = ("auth", "policy", "config", "signatures", "engines", "tls", "admin", "rate_limit", "lifecycle", "scan")


def write_events(events: DataFrame, folder: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(folder)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("category string, action string, timestamp double, details string, ip string, key_prefix string").json(folder)


def last_events(events: DataFrame, time: str, tie: str, category: str | None = None, limit: int = 100) -> DataFrame:
    """The newest ``limit`` events (a top-k report), of one category if given; rows without time come last."""
    rows = events if category is None else events.where(F.col("category") == category)
    return rows.orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc()).limit(limit)


def event_counts(events: DataFrame) -> DataFrame:
    """category, events."""
    return events.groupBy("category").agg(F.count(F.lit(1)).alias("events"))


def log_events(scanned: DataFrame, *keys: str) -> DataFrame:
    """One JSON document per scan: keys, decision, score, number and ids of matches."""
    body = F.struct(*keys, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "decision", "score", F.size("matches").alias("match_count"), F.transform("matches", lambda m: m["signature_id"]).alias("signatures"))
    return scanned.select(F.to_json(body).alias("value"))


def shipper(send: Callable[[str], None] | None) -> Callable[[DataFrame, int], None] | None:
    """A ``foreachBatch`` sink that hands each log line to ``send``; None if nothing is configured.

    Lines are sent from the executors, and failures are swallowed.
    """
    if send is None:
        return None

    def ship(batch: DataFrame, _number: int) -> None:
        def each(rows) -> None:
            for row in rows:
                try:
                    send(row.value)
                except Exception:  # noqa: BLE001
                    pass

        batch.foreachPartition(each)

    return ship
