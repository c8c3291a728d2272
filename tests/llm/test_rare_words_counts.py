"""Elements are counted over every multiset, and counts of any size order them."""

import numpy as np
from pyspark.sql import functions as F

from textward.llm import rare_words
from textward.llm.p1_near_copies import pack, unpack


def elements_of_buckets(*buckets):
    """One element for each bucket."""
    some = np.arange(1, 2**20, dtype=np.uint64)
    at = rare_words._bucket(some)
    return np.array([some[np.flatnonzero(at == b)[0]] for b in buckets], dtype=np.uint64)


def test_every_multiset_is_counted(spark):
    own = elements_of_buckets(5, 900)
    sets = spark.range(200_001).select(F.col("id").alias("node"), F.lit(bytearray(pack(own))).alias("bag"))
    got = rare_words.counts(sets, unpack)
    assert {int(b): int(got[b]) for b in np.flatnonzero(got)} == {5: 200_001, 900: 200_001}


def test_no_multisets(spark):
    sets = spark.range(0).select(F.col("id").alias("node"), F.lit(bytearray()).alias("bag"))
    assert not rare_words.counts(sets, unpack).any()


def test_counts_beyond_24_bits_keep_their_order(spark):
    own = elements_of_buckets(*range(10))
    often = np.zeros(rare_words.BUCKETS, dtype=np.int64)
    often[:10] = 2**40 - np.arange(10)
    bag = bytearray(pack(np.sort(own)))
    sets = spark.createDataFrame([(0, 1, 1, 0, 0, bag)], "kind int, node long, grp long, high long, low long, bag binary")
    rows = rare_words.heads(sets, often, 0.8, unpack).orderBy("place").collect()
    # the rarest 10 - 8 + 1 of 10
    assert [r.element for r in rows] == own[[9, 8, 7]].tolist()
