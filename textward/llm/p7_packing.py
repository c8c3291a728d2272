"""Problem 7: documents packed into containers of fixed capacity.

Sizes are rounded up to BINS classes of the capacity and counted. Patterns of a few documents
that fill a container are enumerated, non-negative least squares fit their repeat counts to the
histogram, the counts are rounded, and the residue is packed class by class, largest first. All
this works on the histogram (BINS numbers a capacity). Documents find their container from their
rank in their class, without being gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm.data import small
from textward.llm.sizes import document_sizes, slices_for
from textward.operators.prefix import order_hash, with_prefix
from textward.sources.tables import table

#: Size classes of a capacity; a document takes up to 1/BINS of the capacity more than it has.
BINS = 512
#: Patterns enumerated for each class that occurs, and the least part of a container they fill.
TRIES, FULL = 8, 0.99


def enumerate_patterns(hist: np.ndarray, rng: np.random.Generator) -> list[dict[int, int]]:
    """Patterns {class: documents}: for each class, random companions and a best-fitting last one."""
    bins = np.flatnonzero(hist)
    share = hist[bins] / hist.sum()
    out: dict[tuple, None] = {}
    for first in bins[::-1]:
        for _ in range(TRIES):
            items, left = [int(first)], BINS - int(first)
            while left >= bins[0]:
                fits = np.searchsorted(bins, left, side="right")
                exact = fits and bins[fits - 1] == left
                if exact and rng.random() < 0.7 or len(items) > 40:
                    pick = bins[fits - 1]
                else:
                    p = share[:fits] / share[:fits].sum()
                    pick = bins[min(fits - 1, int(np.searchsorted(np.cumsum(p), rng.random())))]
                items.append(int(pick))
                left -= int(pick)
            if BINS - left >= FULL * BINS:
                out[tuple(sorted(items, reverse=True))] = None
    return [{b: items.count(b) for b in set(items)} for items in out]


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 with a x near h, by accelerated projected gradients."""
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        lipschitz = np.linalg.norm(v) + 1e-9
        v /= lipschitz
    lipschitz *= 1.02
    x = np.zeros(a.shape[1])
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - a.T @ (a @ y - h) / lipschitz)
        step = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / step * (new - x)
        x, t = new, step
    return x


def plan(hist: np.ndarray, seed: int = 7) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): containers for exactly the documents of a histogram (index: class 0..BINS)."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        times = min(times, min(left[b] // m for b, m in pattern.items()))
        if times > 0:
            for b, m in pattern.items():
                left[b] -= m * times
            out.append((pattern, int(times)))

    if left.sum():
        patterns = enumerate_patterns(left, np.random.default_rng(seed))
        if patterns:
            a = np.zeros((BINS + 1, len(patterns)))
            for j, pattern in enumerate(patterns):
                for b, m in pattern.items():
                    a[b, j] = m
            x = nnls(a, left.astype(float))
            for j in np.argsort(-x, kind="stable"):
                take(patterns[j], int(np.round(x[j])))
    while left.sum():
        # the residue: the largest class, completed by the largest that still fits; this uses up a class each time
        pattern: dict[int, int] = {}
        room = BINS
        for b in np.flatnonzero(left)[::-1]:
            m = min(room // int(b), int(left[b]))
            if m:
                pattern[int(b)] = m
                room -= m * int(b)
        take(pattern, int(left.max()))
    return out


def pieces(sizes: DataFrame, targets: dict[str, int]) -> DataFrame:
    """target_id, capacity, doc_id, n_tokens, n_full, rest: the parts a document falls into.

    A document within the capacity is one rest piece; a longer one is cut into full containers
    and a rest, which may be empty. ``targets`` names the capacities.
    """
    listed = F.array(*[F.struct(F.lit(k).alias("target_id"), F.lit(v).cast("int").alias("capacity_tokens")) for k, v in sorted(targets.items())])
    listed = listed.cast("array<struct<target_id:string,capacity_tokens:int>>")
    pairs = sizes.select("*", F.explode(listed).alias("t")).select("doc_id", "n_tokens", "t.*")
    cut = F.when(F.col("n_tokens") > F.col("capacity_tokens"), F.floor(F.col("n_tokens") / F.col("capacity_tokens"))).otherwise(0)
    return pairs.select("target_id", F.col("capacity_tokens").alias("capacity"), "doc_id", "n_tokens", cut.cast("int").alias("n_full")).withColumn("rest", F.col("n_tokens") - F.col("n_full") * F.col("capacity"))


def locate(intervals: dict[str, tuple]):
    """A vectorised function (target, class, rank) -> container of that rank."""

    @F.pandas_udf("long")
    def find(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for target, size, rank in parts:
            out = np.zeros(len(rank), dtype=np.int64)
            for name, (code, start, each, base) in intervals.items():
                at = (target == name).to_numpy()
                r = rank.to_numpy()[at]
                code_of = size.to_numpy()[at].astype(np.int64) << np.int64(44)
                k = np.searchsorted(code, code_of + r, side="right") - 1
                out[at] = base[k] + (r - start[k]) // each[k]
            yield pd.Series(out)

    return find


def capacities(spark: SparkSession, folder: str) -> dict[str, int]:
    """Capacity of each target; the largest, where one is named twice; targets without a capacity are left out."""
    rows = table(spark, folder, "pack_targets").where("target_id IS NOT NULL AND capacity_tokens > 0")
    return {r.target_id: r.c for r in small(rows.groupBy("target_id").agg(F.max("capacity_tokens").alias("c")))}


def packing(spark: SparkSession, folder: str) -> DataFrame:
    """target_id, container_id, doc_id, piece, n_tokens: every token of every document, packed.

    ``piece`` counts a document's pieces from 0; the tokens of a container sum to at most the
    target's capacity. No documents or no targets give an empty result.
    """
    parts = pieces(document_sizes(spark, folder), capacities(spark, folder))
    size = F.ceil(F.col("rest") * BINS / F.col("capacity")).cast("int")
    items = parts.where("rest > 0").withColumn("size", size).withColumn("ord", order_hash("doc_id", "target_id"))
    # at most BINS rows a target
    counted = items.groupBy("target_id", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    intervals: dict[str, tuple] = {}
    used: dict[str, int] = {}
    for name in {r.target_id for r in counted}:
        hist = np.zeros(BINS + 1, dtype=np.int64)
        for r in counted:
            if r.target_id == name:
                hist[r["size"]] = r.n
        base, at, rows = 0, {}, []
        for pattern, times in plan(hist):
            for b, m in pattern.items():
                start = at.get(b, 0)
                rows.append(((b << 44) + start, start, m, base))
                at[b] = start + m * times
            base += times
        rows.sort()
        intervals[name] = tuple(np.array(x, dtype=np.int64) for x in zip(*rows))
        used[name] = base
    slices = slices_for(max([r.n for r in counted], default=0))
    ranked = with_prefix(items, ["target_id", "size"], "ord", ["doc_id"], slices=slices)
    rests = ranked.select("target_id", locate(intervals)("target_id", "size", "rank").alias("container_id"), "doc_id", F.col("n_full").alias("piece"), F.col("rest").alias("n_tokens"))
    full = with_prefix(parts.where("n_full > 0").withColumn("ord", order_hash("doc_id", "target_id")), ["target_id"], "ord", ["doc_id"], "n_full", slices=slices)
    first = F.coalesce(F.create_map(*[x for k, v in used.items() for x in (F.lit(k), F.lit(v))])[F.col("target_id")] if used else F.lit(None).cast("long"), F.lit(0))
    whole = full.select("target_id", "capacity", "doc_id", (first + F.col("before")).alias("c0"), F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece"))
    return rests.unionByName(whole.select("target_id", (F.col("c0") + F.col("piece")).alias("container_id"), "doc_id", "piece", F.col("capacity").alias("n_tokens")))


def fill(spark: SparkSession, folder: str) -> DataFrame:
    """target_id, containers, tokens, fill (share of the room used)."""
    rows = packing(spark, folder).groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("t"))
    known = capacities(spark, folder)
    room = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.lit(None).cast("map<string,int>")
    sums = rows.groupBy("target_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    return sums.select("target_id", "containers", "tokens", (F.col("tokens") / F.col("containers") / room[F.col("target_id")]).alias("fill"))
