"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.operators.hotkeys import attach
from textward.session import drop_table, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Each step sends a node's neighbours to its smallest neighbour by an aggregate and a join,
    so nothing is gathered per node, and the neighbours of hubs are joined where they lie: a star of
    any size stays spread. Repeats until a step changes nothing. Self-loops and repeated edges are harmless; null ends are left out;
    an empty table gives an empty result. The edges are written to the shared folder each step.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    # label table: node -> smallest known; starts at itself, so each node has a row
    links = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_c")).select("u", F.least("u", "m").alias("m"), "_c")
        # large star: neighbours above the node hang on its minimum
        large = _attached(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: neighbours not above the node, and the node, hang on their minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_c"))
        small = _attached(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        step = materialise(small.where("u <> v").distinct(), "links")
        stat = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        drop_table(links)
        links = step
        if tuple(stat) == seen:
            break
        seen = tuple(stat)
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _attached(facts: DataFrame, stars: DataFrame) -> DataFrame:
    """Facts with the minimum of their node; nodes with most neighbours go to the facts, not the facts to them."""
    return attach(facts, stars.select("u", "m"), ["u"], counts=stars.select("u", "_c"))
