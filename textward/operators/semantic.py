"""Similarity of embedding vectors to the reference phrases of signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Neighbours looked at before the best of each signature is taken.
NEIGHBOURS = 10
DEFAULT_THRESHOLD = 0.75
#: An index is broadcast only up to this many phrases (64 MB at 384 dimensions); larger ones are refused.
MOST_PHRASES = 20_000


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1.0, norm)


class PhraseIndex:
    """A flat inner-product index: unit vectors with their labels and phrase ids."""

    def __init__(self, ids: list[int], labels: list[str], vectors: np.ndarray) -> None:
        if len(ids) > MOST_PHRASES:
            raise ValueError(f"{len(ids)} phrases; an index may have {MOST_PHRASES}")
        self.ids, self.labels = list(ids), list(labels)
        self.vectors = unit(np.asarray(vectors, dtype=np.float64).reshape(len(ids), -1)) if len(ids) else np.zeros((0, 0))

    @classmethod
    def from_frame(cls, phrases: DataFrame, ident: str, label: str, vector: str) -> PhraseIndex:
        """From a small table of phrases (checked: at most MOST_PHRASES rows come to the driver)."""
        rows = phrases.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), F.col(label).cast("string").alias("l"), F.col(vector).alias("v")).orderBy("i").limit(MOST_PHRASES + 1).collect()
        return cls([r.i for r in rows], [r.l for r in rows], np.array([r.v for r in rows], dtype=np.float64))

    def nearest(self, vector: str, k: int = NEIGHBOURS):
        """Column: ARRAY<STRUCT<rank, phrase_id, label, similarity>> of the k most similar phrases; ties by id."""
        ids, labels, vectors = np.array(self.ids, dtype=np.int64), self.labels, self.vectors
        kind = T.ArrayType(T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("phrase_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("similarity", T.DoubleType())]))

        @F.pandas_udf(kind)
        def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                good = part.notna().to_numpy()
                out: list = [None if not g else [] for g in good]
                if good.any() and len(ids):
                    sims = unit(np.array([np.asarray(v, dtype=np.float64) for v in part[good]])) @ vectors.T
                    for row, s in zip(np.flatnonzero(good), sims):
                        # rounded for ties, so that equal phrases come in the order of their ids
                        top = np.lexsort((ids, -np.round(s, 9)))[:k]
                        out[row] = [{"rank": r + 1, "phrase_id": int(ids[j]), "label": labels[j], "similarity": float(s[j])} for r, j in enumerate(top)]
                yield pd.Series(out, dtype=object)

        return search(vector)


def best_per_signature(scored: DataFrame, key: str, neighbours: str = "neighbours") -> DataFrame:
    """key, label, similarity: the best neighbour of each label, if it is above 0.

    A label whose best phrase is not among the neighbours is not seen.
    """
    rows = scored.select(key, F.explode(neighbours).alias("n")).where("n.similarity > 0")
    return rows.groupBy(key, F.col("n.label").alias("label")).agg(F.max("n.similarity").alias("similarity"))


def hits(scored: DataFrame, thresholds: dict[str, float], key: str, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """key, signature_id, similarity, matched_text of labels that reach their threshold."""
    best = best_per_signature(scored, key)
    table = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))]) if thresholds else None
    limit = F.coalesce(table[F.col("label")], F.lit(default)) if table is not None else F.lit(default)
    return best.where(F.col("similarity") >= limit).select(key, F.col("label").alias("signature_id"), "similarity", F.format_string("semantic similarity=%.3f", "similarity").alias("matched_text"))
