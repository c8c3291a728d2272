"""LSH forest: near neighbours of multisets from several sorted signature orders.

Every record (a multiset of words) gets POOL minwise values. A tree is a signature order:
LEVELS of these values, BITS bits each, most significant first, in one 64-bit number. In the
sorted order of a tree the records with the longest common prefix stand side by side, so the
prefix length adapts to the density of the region: in a sparse region neighbours share a short
prefix, in a dense one a long prefix. Every record looks at the next records in each tree as long as
they share a prefix of LEAST levels with it, at most WINDOW, and a pair becomes a candidate if a sketch of two bits of every pool value agrees often
enough for the threshold. Work per record is constant, whatever the density.

Of a record's candidates in one tree the nearest KEEP are passed on at once. Both ends of every
candidate held back go round again without that limit, with the groups found so far, so that each
candidate is either counted exactly or lies inside one group (``p1_near_copies.grouped``).

Records that agree in SHARED levels with more than WINDOW others on one side, and those at the edge
of a sorted part, are reported as crowded: both ends of a pair that agrees in SHARED levels of some
tree and does not meet in a window are among them (``rare_words`` pairs these).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TREES = 12
LEVELS = 12
BITS = 5
POOL = 64
WINDOW = 64
KEEP = 4
#: A pair at 0.8 agrees in so many levels of one tree or another with probability 0.99.
SHARED = 5
#: Levels two records share at least. A pair at 0.8 does in one tree or another but for one of 7,000.
LEAST = 3
PAIR, HELD, CROWDED = 0, 1, 2
_U = np.uint64


@functools.lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    odd = rng.integers(1, 2**63, POOL, dtype=np.uint64) * _U(2) + _U(1)
    order = np.array([rng.permutation(POOL)[:LEVELS] for _ in range(TREES)])
    return odd, order


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def signatures(elements: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree keys (n x TREES) and sketches (2 x n, a bit plane each) of the sets elements[starts[i]:starts[i+1]].

    Sets must not be empty.
    """
    odd, order = _constants()
    n = len(starts)
    pool = np.empty((POOL, n), dtype=np.uint64)
    for i in range(POOL):
        value = elements * odd[i]
        value ^= value >> _U(29)
        pool[i] = np.minimum.reduceat(value * odd[POOL - 1 - i], starts)
    pool = mix(pool)
    sketch = np.zeros((2, n), dtype=np.uint64)
    for i in range(POOL):
        sketch[0] |= (pool[i] >> _U(63)) << _U(i)
        sketch[1] |= ((pool[i] >> _U(62)) & _U(1)) << _U(i)
    low = pool & _U(2**BITS - 1)
    keys = np.zeros((TREES, n), dtype=np.uint64)
    for t in range(TREES):
        for level in order[t]:
            keys[t] = (keys[t] << _U(BITS)) | low[level]
        keys[t] |= _U(t) << _U(LEVELS * BITS)
    return keys.T, sketch


def common_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levels of the common prefix of tree keys, -1 for different trees."""
    differ = a ^ b
    out = np.full(len(a), -1, dtype=np.int8)
    for level in range(LEVELS + 1):
        out += (differ >> ((LEVELS - level) * BITS)) == 0
    return out


def agreement(threshold: float) -> int:
    """Sketch places that must agree: three and a half deviations below the mean at the threshold."""
    p = threshold + (1 - threshold) / 4
    return int(POOL * p - 3.5 * (POOL * p * (1 - p)) ** 0.5)


def candidates(rows: DataFrame, threshold: float, keep: int = KEEP) -> DataFrame:
    """a, b, mark (PAIR, HELD or CROWDED) of a table kind, node[, grp], key, high, low, one row per record and tree.

    The table is range-partitioned by key and node, so a region of any density is cut into
    equal parts; each part is scanned with vector operations. Pairs inside one ``grp`` are
    left out, where the table has groups. A record's pairs beyond ``keep`` are not passed on; both ends of them come as rows
    marked HELD. With ``keep`` at WINDOW none is held back.
    """
    least = agreement(threshold)
    names = ["node", "key", "high", "low", "kind", *(["grp"] if "grp" in rows.columns else [])]
    spread = rows.repartitionByRange("kind", "key", "node").sortWithinPartitions("kind", "key", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None
        passed = 0
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
            if passed < WINDOW:
                yield _marked(cols[0][: WINDOW - passed], CROWDED)
            passed += len(batch)
            if tail is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(tail, cols)]
            known = 0 if tail is None else len(tail[0])
            yield from _scan(cols, known, least, keep)
            tail = [x[-WINDOW:] for x in cols]
        if tail is not None:
            yield _marked(tail[0], CROWDED)

    return spread.select(*names).mapInArrow(scan, "a long, b long, mark int")


def _marked(node: np.ndarray, mark: int) -> pa.RecordBatch:
    node = np.unique(node)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node), pa.array(np.full(len(node), mark, np.int32))], ["a", "b", "mark"])


def _scan(cols: list[np.ndarray], known: int, least: int, keep: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose later record is not among the first ``known`` ones."""
    node, key, high, low, kind = cols[:5]
    group = cols[5] if len(cols) > 5 else node
    n = len(node)
    taken = np.zeros(n, dtype=np.int32)
    out_a, out_b = [], []
    held = np.zeros(n, dtype=bool)
    # common prefixes of neighbours; that of two records is the least between them
    adjacent = common_levels(key[1:], key[:-1])
    i, common = np.arange(n - 1), adjacent
    for step in range(1, min(WINDOW, n - 1) + 1):
        # each record looks as far as its region goes: in a sparse one the prefix ends soon
        if step > 1:
            here = i + step < n
            i = i[here]
            common = np.minimum(common[here], adjacent[i + step - 1])
        deep = common >= LEAST
        i, common = i[deep], common[deep]
        if not len(i):
            break
        x = i[i + step >= known]
        y = x + step
        differ = (high[x] ^ high[y]) | (low[x] ^ low[y])
        ok = (POOL - np.bitwise_count(differ.view(np.uint64)) >= least) & (group[x] != group[y]) & (kind[x] == kind[y])
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        # counted at the later record, which has its whole window before it
        full = taken[y] >= keep
        held[x[full]] = held[y[full]] = True
        x, y = x[~full], y[~full]
        taken[y] += 1
        out_a.append(np.minimum(node[x], node[y]))
        out_b.append(np.maximum(node[x], node[y]))
    yield _marked(node[held], HELD)
    if n > WINDOW:
        prefix = key >> ((LEVELS - SHARED) * BITS)
        i = np.arange(max(0, known - WINDOW), n - WINDOW)
        i = i[(prefix[i] == prefix[i + WINDOW]) & (kind[i] == kind[i + WINDOW])]
        yield _marked(node[np.concatenate([i, i + WINDOW])], CROWDED)
    if out_a:
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), PAIR, np.int32))], ["a", "b", "mark"])
