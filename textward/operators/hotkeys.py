"""Joins of a fact table with hot keys to a table that is unique per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key outside the HOT most frequent ones holds at most 1/(HOT+1) of all rows.
HOT = 1024


def attach(facts: DataFrame, unique: DataFrame, keys: list[str], hot: int = HOT, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``keys``; ``unique`` has one row per key, null keys match nothing.

    The ``hot`` most frequent keys (at most that many rows, so the broadcast is bounded) are
    joined where the rows lie; the rest is shuffled. No row is dropped or capped, and no key
    brings more than 1/(hot+1) of the rows into one task. The facts should be narrow: they are
    read three times, or twice where ``counts`` (keys, _c) tells how many rows each key has.
    """
    if counts is None:
        counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    top = counts.where("_c > 1000").orderBy(F.desc("_c"), *keys).limit(hot).select(*keys)
    small = F.broadcast(unique.join(F.broadcast(top), keys, "left_semi"))
    by_place = facts.join(small, keys)
    by_shuffle = facts.join(F.broadcast(top), keys, "left_anti").join(unique, keys)
    return by_place.unionByName(by_shuffle)
