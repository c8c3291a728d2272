"""Problem 4: records that look the same although they are written with other characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm.data import form_key, kind_name, records
from textward.llm.lookalike import consistent_form
from textward.operators.hotkeys import attach
from textward.session import materialise


def forms(spark: SparkSession, folder: str) -> DataFrame:
    """kind, id, raw (hash of the text as written), form (hash pair of the consistent form).

    One row per record; 128 bits of hash stand for the text, which is not shuffled.
    """
    form = consistent_form(form_key(spark, folder))
    df = records(spark, folder).select("kind", "id", F.xxhash64("text").alias("raw"), form("text").alias("f"))
    df = df.select("kind", "id", "raw", F.xxhash64("f").alias("h1"), F.xxhash64(F.lit(7), F.reverse("f")).alias("h2"))
    return df.groupBy("kind", "id").agg(F.min(F.struct("raw", "h1", "h2")).alias("x")).select("kind", "id", "x.*")


def classes(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, form_id (smallest id of the class), written (ways of writing), records.

    One row per consistent form that is written in more than one way, however large its class.
    """
    per_raw = forms(spark, folder).groupBy("kind", "h1", "h2", "raw").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    groups = per_raw.groupBy("kind", "h1", "h2").agg(F.min("low").alias("form_id"), F.count(F.lit(1)).alias("written"), F.sum("n").alias("records"))
    return groups.where("written > 1").select(kind_name(F.col("kind")).alias("record_kind"), "form_id", "written", "records")


def members(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, form_id, record_id: every record of the classes of :func:`classes`.

    The linear form of the pairs of :func:`found`: one row per record, however large a class.
    """
    rows = materialise(forms(spark, folder), "forms")
    groups = rows.groupBy("kind", "h1", "h2").agg(F.min("id").alias("form_id"), F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count(F.lit(1)).alias("_c"))
    several = groups.where("lo <> hi")
    keys = ["kind", "h1", "h2"]
    out = attach(rows, several.select(*keys, "form_id"), keys, counts=several.select(*keys, "_c"))
    return out.select(kind_name(F.col("kind")).alias("record_kind"), "form_id", F.col("id").alias("record_id"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of one kind whose texts differ but whose consistent forms are equal.

    Only records whose form is written in more than one way enter the join. The result is
    defined as pairs, so a form written in many ways gives many rows; each side of a large
    class is split over SALT tasks.
    """
    rows = materialise(forms(spark, folder), "forms")
    several = rows.groupBy("kind", "h1", "h2").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("kind", "h1", "h2")
    part = rows.join(several, ["kind", "h1", "h2"], "left_semi")
    salt = 8
    left = part.select("kind", "h1", "h2", F.col("id").alias("id_a"), F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int").alias("s"))
    right = part.select("kind", "h1", "h2", F.col("id").alias("id_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("s"))
    pairs = left.join(right, ["kind", "h1", "h2", "s"]).where("id_a < id_b AND raw_a <> raw_b")
    return pairs.select(kind_name(F.col("kind")).alias("record_kind"), "id_a", "id_b")
