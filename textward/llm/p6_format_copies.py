"""Problem 6: records that differ only in formatting, collapsed and counted.

Dictionary encoding: every record becomes fields (name, value); each distinct field is made
canonical once (letter case folded, white space and punctuation removed), distinct canonical
fields get integer ids, a record is the sorted tuple of its ids, and equal tuples are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm.data import form_key, requests
from textward.llm.fields import parse_fields
from textward.llm.lookalike import rewriter_of
from textward.operators.hotkeys import attach
from textward.session import drop_table, materialise

#: Removed from a field before comparison: white space, separators, control and format
#: characters, punctuation, and the ASCII symbols that serve as punctuation.
IGNORED = r"[\s\p{Z}\p{C}\p{P}$+<=>^`|~]+"


def split_fields(key: tuple):
    """STRING -> ARRAY<STRUCT<name, value>> of the text's consistent form."""

    @F.pandas_udf("array<struct<name:string,value:string>>")
    def fields(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = rewriter_of(key)
        for part in texts:
            yield pd.Series([[{"name": n, "value": v} for n, v in parse_fields(rewrite(t))] for t in part], dtype=object)

    return fields


def canonical(col) -> F.Column:
    """Letter case folded (by upper and lower, so that sharp s equals ss), formatting removed."""
    return F.regexp_replace(F.lower(F.upper(col)), IGNORED, "")


def tuples(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, c1, c2: 128 bits of hash of the sorted integer tuple of each request's fields, written.

    Texts are shuffled once, to build the dictionary of distinct fields; rows carry 128 bits of
    hash until they carry integer ids. Field names are part of the field, prose has none.
    """
    split = split_fields(form_key(spark, folder))
    rows = requests(spark, folder).select("request_id", split("text").alias("f"))
    cells = rows.select("request_id", F.posexplode("f").alias("at", "x")).select(
        "request_id",
        "at",
        F.concat_ws("\u0001", "x.name", "x.value").alias("field"),
        F.xxhash64("x.name", "x.value").alias("k1"),
        F.xxhash64(F.lit(7), "x.value", "x.name").alias("k2"),
    ).persist()
    distinct = cells.groupBy("k1", "k2").agg(F.first("field").alias("field"))
    names = F.substring_index("field", "\u0001", 1)
    clean = distinct.select("k1", "k2", canonical(names).alias("n"), canonical(F.expr("substring(field, instr(field, '\u0001') + 1)")).alias("v"))
    spelled = clean.select("k1", "k2", F.xxhash64("n", "v").alias("c1"), F.xxhash64("v", "n").alias("c2"))
    spelled = materialise(spelled, "fields")
    # integers for the distinct canonical fields, fixed by writing them
    ids = materialise(spelled.select("c1", "c2").distinct().withColumn("field_id", F.monotonically_increasing_id()), "dictionary")
    dictionary = spelled.join(ids, ["c1", "c2"]).select("k1", "k2", "field_id")
    coded = attach(cells.select("request_id", "at", "k1", "k2"), dictionary, ["k1", "k2"])
    # one array per delivery's field position would repeat with re-deliveries: positions make cells unique
    single = coded.groupBy("request_id", "at").agg(F.min("field_id").alias("field_id"))
    code = single.groupBy("request_id").agg(F.sort_array(F.collect_list("field_id")).alias("code"))
    try:
        return materialise(code.select("request_id", F.xxhash64("code").alias("c1"), F.xxhash64(F.lit(7), "code").alias("c2")), "tuples")
    finally:
        cells.unpersist()
        for done in (spelled, ids):
            drop_table(done)


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """group_id (smallest request of the group), copies: one row per distinct record."""
    rows = tuples(spark, folder)
    return rows.groupBy("c1", "c2").agg(F.min("request_id").alias("group_id"), F.count(F.lit(1)).alias("copies")).select("group_id", "copies")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, group_id for the members of groups of two or more."""
    rows = tuples(spark, folder)
    several = rows.groupBy("c1", "c2").agg(F.min("request_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return attach(rows, several, ["c1", "c2"]).select("request_id", "group_id")
