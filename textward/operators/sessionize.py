"""Audit events grouped into sessions per caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.operators.gap_tree import cut, gap_tree
from textward.sources.tables import table

#: A gap of so many seconds ends a session.
GAP = 1800
#: Gap settings compared with one another.
SETTINGS = (60, 300, 900, 1800, 3600, 14400, 86400)


def actor_of(key_prefix, ip) -> F.Column:
    """The caller: the key prefix without blanks, else the address in one form; null if neither.

    Addresses are lower-cased; an IPv4 address mapped into IPv6, dotted or in hexadecimal, is
    written as IPv4.
    """
    blank = r"^(?U)\s+|(?U)\s+$"
    key = F.regexp_replace(key_prefix, blank, "")
    address = F.lower(F.regexp_replace(ip, blank, ""))
    dotted = F.regexp_extract(address, r"^(?:0{0,4}:){2,5}ffff:(?:0:)?(\d+\.\d+\.\d+\.\d+)$", 1)
    high = F.conv(F.regexp_extract(address, r"^(?:0{0,4}:){2,5}ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", 1), 16, 10).cast("int")
    low = F.conv(F.regexp_extract(address, r"^(?:0{0,4}:){2,5}ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", 2), 16, 10).cast("int")
    hexed = F.concat_ws(".", F.floor(high / 256), high % 256, F.floor(low / 256), low % 256)
    plain = F.when(dotted != "", dotted).when(address.rlike(r"^(?:0{0,4}:){2,5}ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), hexed).otherwise(address)
    return F.when(F.length(key) > 0, key).when(F.length(plain) > 0, plain)


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    """actor, ts, id: each audit event once, with a caller and a time.

    Deliveries of an event differ in ``ingested_at`` only; the earliest stands for it.
    """
    rows = table(spark, folder, "audit_log").where("audit_id IS NOT NULL").select("audit_id", "ingested_at", "event_ts", actor_of(F.col("key_prefix"), F.col("ip")).alias("actor"))
    once = rows.groupBy("audit_id").agg(F.min(F.struct(F.col("ingested_at").isNull(), "ingested_at", F.col("event_ts").isNull(), "event_ts", "actor")).alias("x"))
    return once.select("x.actor", F.col("x.event_ts").alias("ts"), F.col("audit_id").alias("id")).where("actor IS NOT NULL AND ts IS NOT NULL")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """actor, first_audit_id, last_audit_id: one row per session."""
    return cut(gap_tree(audit_events(spark, folder)), GAP).select("actor", F.col("first_id").alias("first_audit_id"), F.col("last_id").alias("last_audit_id"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """actor, first_id, last_id, start, end, duration (seconds), events: one row per session."""
    return cut(gap_tree(audit_events(spark, folder)), GAP)


def gap_settings(spark: SparkSession, folder: str) -> DataFrame:
    """gap_s, sessions, longest_s for several gap settings, all cut from one tree."""
    tree = gap_tree(audit_events(spark, folder))
    settings = F.array(*[F.lit(x).cast("long") for x in SETTINGS])
    rows = tree.select("height", "parent", (F.col("end") - F.col("start")).alias("d"), F.explode(settings).alias("gap_s")).where("height < gap_s AND parent >= gap_s")
    return rows.groupBy("gap_s").agg(F.count(F.lit(1)).alias("sessions"), (F.max("d") / 1000000.0).alias("longest_s"))
