"""Problem 1: groups of records that repeat one another with small changes.

Words are maximal runs of letters and digits of the lower-cased consistent form; similarity is
shared words over words in either, repeats counted each time. Candidates come from an LSH
forest and, in dense regions, from the rarest words; an exact count of shared words decides, and
groups are closed under links.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import lsh_forest as forest
from textward.llm import rare_words
from textward.llm.data import form_key, kind_name, records
from textward.llm.lookalike import rewriter_of
from textward.operators.components import components
from textward.operators.hotkeys import attach
from textward.session import drop_table, materialise

#: Two records are linked at this similarity.
THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")


class _Codes(dict):
    """Hashes of words, worked out when first needed."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_WORDS = _Codes()
ELEMENT_BYTES = 5
_MASK = np.uint64(2 ** (8 * ELEMENT_BYTES) - 1)


_SHIFT, _OWNER = np.uint64(8 * ELEMENT_BYTES), 64 - 8 * ELEMENT_BYTES
_AGAIN = np.uint64(0x9E3779B97F4A7C15)


def bags_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(elements, counts): the word multisets of texts one after another, each sorted.

    There is one element for each word and repeat number. Elements are hashes of 40 bits: two
    different ones in one pair of texts of a thousand words agree by accident in one of a million pairs.
    """
    if len(_WORDS) > 500_000:
        _WORDS.clear()
    words = [_WORD.findall(t.lower()) for t in texts]
    many = np.array([len(x) for x in words], dtype=np.int64)
    codes = np.fromiter(map(_WORDS.__getitem__, itertools.chain.from_iterable(words)), dtype=np.uint64, count=int(many.sum()))
    if len(texts) >= 2**_OWNER:
        raise ValueError("too many texts in one batch")
    # one number for text and word, so that plain sorts do
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64) << _SHIFT, many)
    codes = np.sort(owner | (codes & _MASK))
    # the repeat number is the place in a run of equal words of one text
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = codes[1:] != codes[:-1]
    place = np.arange(len(codes))
    again = (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(np.uint64)
    elements = np.sort(codes & ~_MASK | (codes + _AGAIN * again) & _MASK)
    keep = np.ones(len(elements), dtype=bool)
    keep[1:] = elements[1:] != elements[:-1]
    elements = elements[keep]
    return elements & _MASK, np.bincount((elements >> _SHIFT).astype(np.int64), minlength=len(texts))


def bag(text: str) -> np.ndarray:
    """The multiset of one text."""
    return bags_of([text])[0]


def pack(elements: np.ndarray) -> bytes:
    """ELEMENT_BYTES bytes for each element."""
    return elements.view(np.uint8).reshape(-1, 8)[:, :ELEMENT_BYTES].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """The elements behind :func:`pack`."""
    short = np.frombuffer(blob, np.uint8).reshape(-1, ELEMENT_BYTES)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :ELEMENT_BYTES] = short
    return wide.view(np.uint64).ravel()


def bags(df: DataFrame, key: tuple) -> DataFrame:
    """kind, id, node, bag of records kind, id, text.

    ``node`` is a 63-bit number of the kind and word multiset (records with equal multisets
    share it; they need no comparison). Records without any word have similarity to nothing and
    are left out.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter_of(key)
        for batch in batches:
            elements, many = bags_of([rewrite(t) for t in batch.column(2).to_pylist()])
            blob, ends = pack(elements), (np.cumsum(many) * ELEMENT_BYTES).tolist()
            rows, at = [], 0
            for kind, i, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends):
                if end > at:
                    own = blob[at:end]
                    rows.append((kind, i, xxhash.xxh3_64_intdigest(own, seed=kind) & 0x7FFFFFFFFFFFFFFF, own))
                at = end
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["kind", "id", "node", "bag"])

    return df.select("kind", "id", "text").mapInArrow(build, "kind int, id long, node long, bag binary")


def signed(sets: DataFrame) -> DataFrame:
    """kind, node, keys, high, low of multisets kind, node, bag: the signature of each."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = [unpack(x) for x in batch.column(2).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]])
            keys, sketch = forest.signatures(forest.mix(np.concatenate(parts)), starts)
            planes = [pa.array(x.view(np.int64)) for x in sketch]
            flat = pa.array(np.ascontiguousarray(keys).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, forest.TREES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, *planes], ["kind", "node", "keys", "high", "low"])

    return sets.select("kind", "node", "bag").mapInArrow(sign, "kind int, node long, keys array<long>, high long, low long")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b of nodes whose multisets reach the threshold exactly."""
    one = sets.select("node", "bag")
    both = pairs.join(one.withColumnsRenamed({"node": "a", "bag": "bag_a"}), "a").join(one.withColumnsRenamed({"node": "b", "bag": "bag_b"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                low, high = sorted((len(x) // ELEMENT_BYTES, len(y) // ELEMENT_BYTES))
                if low >= threshold * high - 1e-9:
                    shared = len(np.intersect1d(unpack(x), unpack(y), assume_unique=True))
                    ok[i] = shared >= threshold * (low + high - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(check, "a long, b long")


def regrouped(roots: DataFrame, fresh: DataFrame) -> DataFrame:
    """(node, root) after further links a, b: only the groups these join are worked on again."""
    ends = fresh.select(F.col("a").alias("node")).union(fresh.select(F.col("b").alias("node"))).distinct()
    base = roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    side = lambda end: base.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    over = fresh.join(side("a"), "a").join(side("b"), "b").select("ra", "rb").where("ra <> rb").distinct()
    over = materialise(over, "over")
    if over.isEmpty():
        return base
    # one select: renaming node to root and root to top one after the other would make both top
    joined = materialise(components(over, "ra", "rb"), "joined").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return base.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _roots(sets: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of the groups among multisets kind, node, bag with their signatures, written."""
    rows = signatures.select("kind", "node", F.explode("keys").alias("key"), "high", "low")
    roots, crowded = None, None
    for keep in (forest.KEEP, forest.WINDOW):
        drawn = materialise(forest.candidates(rows, threshold, keep).distinct(), "candidates")
        fresh = materialise(verify(drawn.where(F.col("mark") == forest.PAIR).select("a", "b"), sets, threshold), "near")
        roots = materialise(components(fresh) if roots is None else regrouped(roots, fresh), "roots")
        tight = materialise(drawn.where(F.col("mark") == forest.CROWDED).select(F.col("a").alias("node")), "crowded")
        crowded = tight if crowded is None else crowded.unionByName(tight).distinct()
        held = drawn.where(F.col("mark") == forest.HELD).select(F.col("a").alias("node"))
        dense = signatures.join(held, "node", "left_semi").join(roots, "node", "left")
        dense = materialise(dense.select("kind", "node", F.coalesce("root", "node").alias("grp"), "keys", "high", "low"), "dense")
        drop_table(drawn)
        # candidates held back matter only where they would join two groups of the dense regions
        if dense.agg(F.countDistinct("grp")).first()[0] < 2:
            break
        rows = dense.select("kind", "node", "grp", F.explode("keys").alias("key"), "high", "low")
    # pairs of dense regions that no window holds
    thick = signatures.select("kind", "node", "high", "low").join(crowded, "node", "left_semi").join(roots, "node", "left")
    thick = materialise(thick.select("kind", "node", F.coalesce("root", "node").alias("grp"), "high", "low").join(sets.select("node", "bag"), "node"), "thick")
    heads = rare_words.heads(thick, rare_words.counts(thick, unpack), threshold, unpack)
    drawn = materialise(rare_words.pairs(heads, threshold), "candidates")
    fresh = materialise(verify(drawn, sets, threshold), "near")
    if not fresh.isEmpty():
        roots = materialise(regrouped(roots, fresh), "roots")
    for done in (thick, drawn):
        drop_table(done)
    return roots


def grouped(df: DataFrame, key: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """kind, id, node, root: every record with words, its multiset and the root of its group.

    Empty input gives an empty result; a record linked to nothing is its own root.
    """
    built = bags(df, key).persist()
    # partitioned by node once; the joins of the exact check then move only the pairs
    parts = int(built.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = built.select("kind", "node", "bag").repartition(parts, "node").dropDuplicates(["node"]).persist()
    # kept, since the range partitioning reads its input twice
    signatures = signed(sets).persist()
    try:
        members = materialise(built.select("kind", "id", "node").distinct(), "members")
        roots = _roots(sets, signatures, threshold)
    finally:
        for kept in (built, sets, signatures):
            kept.unpersist()
    out = members.join(roots, "node", "left").select("kind", "id", "node", F.coalesce("root", "node").alias("root"))
    return out


def found(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id, group_id for the members of groups of two or more."""
    rows = grouped(records(spark, folder), form_key(spark, folder))
    rows = materialise(rows.select("kind", "id", "root"), "groups")
    several = rows.groupBy("kind", "root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return attach(rows, several, ["kind", "root"]).select(kind_name(F.col("kind")).alias("record_kind"), F.col("id").alias("record_id"), "group_id")
