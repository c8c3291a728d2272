"""Sizes of documents in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm.tokens import token_count
from textward.session import materialise
from textward.sources.tables import spread, table


def document_sizes(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of the documents with any token, counted once and written.

    Documents without id, with null text or without tokens are left out: they take no room.
    """
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    sized = docs.select("doc_id", "source", token_count(vocabulary)("text").alias("n_tokens"))
    return materialise(sized.where(F.col("n_tokens") > 0), "sizes")


def slices_for(rows: int, per_slice: int = 100_000) -> int:
    """A power of two of slices so that a group of all rows has about ``per_slice`` rows in each."""
    n = 8
    while n * per_slice < rows:
        n *= 2
    return n
