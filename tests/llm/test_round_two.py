"""Exact token counts, repeated garbling, given schedules, members of look-alike classes, word bags."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textward.llm import checks, p4_lookalike_pairs, p8_mixing
from textward.llm import p1_near_copies as p1
from textward.llm import lsh_forest as forest
from textward.llm.tokens import FOLDER, PIECE, VOCABULARY, count, encoding, pieces


def test_tokens_of_long_texts_are_exact():
    path = f"{FOLDER}/{VOCABULARY}"
    encode = encoding(path).encode_ordinary
    for text in ("some words\n\n  and more, it's 12 \t" * 5000, "word" * 20_000 + "  \n" + "x y" * 30_000, " " * 70_000 + "end", "a" * (PIECE - 1) + " \n b" * 9):
        assert "".join(pieces(text)) == text
        assert count(text, path) == len(encode(text))
    assert count("", path) == 0


def test_schedules():
    points = [(0.0, 2.0), (0.5, 0.0), (1.0, 4.0)]
    listed = p8_mixing.stretches(points)
    assert [x[0] for x in listed] == [0.0, 0.5]
    t, w, s, c = listed[1]
    assert abs(c + w * 0.5 + s * 0.125 - 1) < 1e-12
    assert p8_mixing.stretches([]) == [(0.0, 1.0, 0.0, 0.0)] == p8_mixing.stretches([(0.3, 0.0)])


def test_position_inverts_demand(spark):
    listed = p8_mixing.stretches([(0.0, 2.0), (0.5, 0.0), (1.0, 4.0)])
    df = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("l", F.array(*[F.struct(*[F.lit(v) for v in x]) for x in listed]).cast(f"array<{p8_mixing.STRETCH}>"))
    for r in df.select("u", p8_mixing.position(F.col("u"), F.col("l")).alias("x")).collect():
        t, w, s, c = [x for x in listed if x[0] <= r.x][-1]
        assert abs(c + w * (r.x - t) + s * (r.x - t) ** 2 / 2 - r.u) < 1e-9


def test_members_agree_with_pairs(spark, messy, empty):
    pairs = {(r.id_a, r.id_b) for r in p4_lookalike_pairs.found(spark, messy).collect()}
    members = p4_lookalike_pairs.members(spark, messy).collect()
    assert {i for p in pairs for i in p} <= {r.record_id for r in members}
    assert p4_lookalike_pairs.members(spark, empty).count() == 0


def test_bags():
    texts = ["a b a c", "", "__", "B a A", "x" * 9]
    elements, many = p1.bags_of(texts)
    assert many.tolist() == [4, 0, 0, 3, 1]
    first, second = set(elements[:4].tolist()), set(elements[4:7].tolist())
    shared = sum((Counter("a b a c".split()) & Counter("b a a".split())).values())
    assert len(first & second) == shared == 3


def test_common_levels():
    top = np.int64(3) << np.int64(forest.LEVELS * forest.BITS)
    a = np.array([top, top + 1, top + (1 << 59), 1 << 60], dtype=np.int64)
    b = np.array([top, top, top, top], dtype=np.int64)
    assert forest.common_levels(a, b).tolist() == [12, 11, 0, -1]


def test_kept():
    assert checks._kept("call Ann at 5", "call [PERSON_NAME] at 5") and not checks._kept("call Ann at 5", "call [PERSON_NAME] at 6")
    assert not checks._kept("abc", "abd") and checks._kept("Ann", "[PERSON_NAME]")
