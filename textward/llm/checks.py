"""What must hold of results that are not lists of cases, as queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import p3_personal, p7_packing, p8_mixing
from textward.llm.data import small
from textward.llm.pii_spans import PLAIN_EMAIL
from textward.llm.sizes import document_sizes
from textward.sources.tables import table

#: The least part of the room of its containers that a packing fills, where it needs many.
FILLED = 0.97


def leftovers(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, planted_left (plainly written e-mail addresses left in masked texts), altered (masked texts changed elsewhere).

    A text is unchanged elsewhere if the stretches between its placeholders stand in the raw text, in
    order, from its beginning to its end. Both kinds of record have a row.
    """
    raw = p3_personal.texts(spark, folder).groupBy("kind", "id").agg(F.min("text").alias("raw"))
    names = F.when(F.col("record_kind") == p3_personal.KINDS[0], 0).otherwise(1)
    masked = p3_personal.masked(spark, folder).select(names.alias("kind"), F.col("record_id").alias("id"), "masked")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, left, changed = batch.column(0).to_pylist(), [], []
            for before, after in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left.append(len(PLAIN_EMAIL.findall(after)))
                changed.append(int(not _kept(before, after)))
            cols = [pa.array(x, pa.int32()) for x in (kinds, left, changed)]
            yield pa.RecordBatch.from_arrays(cols, ["kind", "left", "changed"])

    both = masked.join(raw, ["kind", "id"]).select("kind", "raw", "masked").mapInArrow(look, "kind int, left int, changed int")
    sums = both.groupBy("kind").agg(F.sum("left").alias("planted_left"), F.sum("changed").alias("altered"))
    every = spark.createDataFrame(list(enumerate(p3_personal.KINDS)), "kind int, record_kind string")
    return every.join(sums, "kind", "left").select("record_kind", F.coalesce("planted_left", F.lit(0)).alias("planted_left"), F.coalesce("altered", F.lit(0)).alias("altered"))


def _kept(raw: str, masked: str) -> bool:
    """Whether masked is raw with stretches replaced by placeholders."""
    parts = [masked]
    for mark in p3_personal.PLACEHOLDER.values():
        parts = [piece for part in parts for piece in part.split(mark)]
    if len(parts) == 1:
        return raw == masked
    if not raw.startswith(parts[0]) or not raw.endswith(parts[-1]):
        return False
    at = len(parts[0])
    for part in parts[1:-1]:
        at = raw.find(part, at)
        if at < 0:
            return False
        at += len(part)
    return at <= len(raw) - len(parts[-1])


def packing_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """target_id, documents, overfull (containers), split_needlessly (documents), tokens_missing, filled (enough of the room)."""
    known = p7_packing.capacities(spark, folder)
    room = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.lit(None).cast("map<string,int>")
    rows = p7_packing.packing(spark, folder)
    per_container = rows.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("t"))
    containers = per_container.groupBy("target_id").agg(
        F.count_if(F.col("t") > room[F.col("target_id")]).alias("overfull"), F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens")
    )
    per_doc = rows.groupBy("target_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    docs = per_doc.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= room[F.col("target_id")])).alias("split_needlessly")
    )
    all_tokens = small(document_sizes(spark, folder).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")))[0].t
    filled = (F.col("tokens") / F.col("containers") / room[F.col("target_id")] >= FILLED) | (F.col("containers") < 20)
    return docs.join(containers, "target_id").select(
        "target_id", "documents", "overfull", "split_needlessly", (F.lit(all_tokens) - F.col("tokens")).alias("tokens_missing"), filled.alias("filled")
    )


def mixing_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """mix_id, sources, shares_met (within the largest document of any source in the mix), repeats_kept."""
    targets = table(spark, folder, "mix_targets").select("mix_id", "source", "max_repeats")
    largest = document_sizes(spark, folder).groupBy("source").agg(F.max("n_tokens").alias("largest"))
    rows = p8_mixing.shares(spark, folder).join(targets, ["mix_id", "source"]).join(largest, "source", "left")
    sums = rows.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"), F.max("largest").alias("grain"))
    near = F.abs(F.col("tokens") - F.col("target_share") * F.col("all_tokens")) <= F.col("grain")
    return rows.join(sums, "mix_id").groupBy("mix_id").agg(
        F.count(F.lit(1)).alias("sources"), F.bool_and(near).alias("shares_met"), F.bool_and(F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept")
    )
