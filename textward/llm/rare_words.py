"""Pairs of similar multisets by their rarest elements, for regions too dense for sorted orders.

Under one order of the elements, rare ones first, two multisets that reach the threshold share an
element among the first ones of both: of the larger one (of n) the n - ceil(t n) + 1 first, of
the smaller one the n - ceil(2 t n / (1 + t)) + 1 first. Any order is right; counts of all
elements make it a good one. No pair is held back: work grows with the records that share a rare
element and are not in one group yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import lsh_forest as forest

#: Elements are counted in so many buckets.
BUCKETS = 2**15
_CHUNK = 4_000_000
_ROW = "kind int, element long, node long, grp long, size int, place int, later boolean, high long, low long"


def _bucket(elements: np.ndarray) -> np.ndarray:
    return (elements * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64)


def counts(sets: DataFrame, unpack) -> np.ndarray:
    """How often the elements of each bucket occur in all multisets bag."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_bucket(unpack(b"".join(batch.column(0).to_pylist()))), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in sets.select("bag").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def heads(sets: DataFrame, often: np.ndarray, threshold: float, unpack) -> DataFrame:
    """The first elements of multisets kind, node, grp, high, low, bag by :func:`counts`; ``later`` ones count for the larger of two only."""
    # ranks of the counts, which fit beside an element whatever the counts are
    order = np.unique(often, return_inverse=True)[1].astype(np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            first, sizes, short = [], [], []
            for blob in batch.column(5).to_pylist():
                elements = unpack(blob)
                n = len(elements)
                ranked = np.sort(order[_bucket(elements)] << np.uint64(40) | elements)
                first.append(ranked[: n - int(np.ceil(threshold * n - 1e-9)) + 1] & np.uint64(2**40 - 1))
                sizes.append(n)
                short.append(n - int(np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)) + 1)
            many = np.array([len(x) for x in first])
            row = pa.array(np.repeat(np.arange(len(first)), many))
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            kind, node, grp, high, low = (batch.column(c).take(row) for c in range(5))
            size = np.repeat(np.array(sizes), many)
            cols = [kind, pa.array(np.concatenate(first).view(np.int64)), node, grp, pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(place >= np.repeat(np.array(short), many)), high, low]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _ROW.split(", ")])

    return sets.select("kind", "node", "grp", "high", "low", "bag").mapInArrow(cut, _ROW)


def pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b of the rows of :func:`heads` that may reach the threshold and are in different groups.

    A block is one element; what stays in memory of it are its rows that are not ``later``.
    """
    least = forest.agreement(threshold)
    ready = rows.repartition("kind", "element").sortWithinPartitions("kind", "element", "later")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(9)]
            kept = 0
            if open_ is not None and open_[0][0] == cols[0][0] and open_[1][0] == cols[1][0]:
                kept = len(open_[0])
                cols = [np.concatenate([x, y]) for x, y in zip(open_, cols)]
            edges = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(cols[0])]])
            out_a, out_b = [], []
            for start, end in zip(starts.tolist(), ends.tolist()):
                if end - start > 1:
                    for a, b in _block([x[start:end] for x in cols[2:]], kept if start == 0 else 0, least, threshold):
                        out_a.append(a)
                        out_b.append(b)
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            last = [x[starts[-1] :] for x in cols]
            stay = ~last[6]
            open_ = [x[stay] for x in last] if stay.any() else None

    return ready.mapInArrow(scan, "a long, b long").distinct()


def _block(cols: list[np.ndarray], kept: int, least: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block's rows with earlier rows that are not later; the first ``kept`` rows were compared before."""
    node, grp, size, place, later, high, low = cols
    known = int((~later).sum())
    if not known or (grp == grp[0]).all():
        return
    need = threshold / (1 + threshold)
    step = max(1, _CHUNK // known)
    for at in range(kept, len(node), step):
        x = np.arange(at, min(at + step, len(node)))
        i, j = x[:, None], np.arange(min(known, int(x[-1])))[None, :]
        differ = (high[i] ^ high[j]) | (low[i] ^ low[j])
        row, col = np.nonzero((forest.POOL - np.bitwise_count(differ.view(np.uint64)) >= least) & (grp[i] != grp[j]) & (j < i))
        i = x[row]
        both = size[i] + size[col]
        most = np.minimum(size[i] - place[i], size[col] - place[col])
        ok = most >= need * both - 1e-9
        yield node[i[ok]], node[col[ok]]

