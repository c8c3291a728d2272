"""Problem 3: personal information in free text, found and replaced by typed placeholders.

Weak supervision: patterns, a gazetteer of names (learned from phrases that introduce a name)
and context words vote on every candidate span. Expectation-maximisation estimates how reliable
each labeler is from the counts of vote patterns over all records, and a logistic classifier
trained on the resulting probabilities, with plain features beside the votes, decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm.data import requests
from textward.llm.lookalike import counts_key, member_counts, rewriter_of
from textward.llm.pii_spans import TYPES, introduced_names, name_words, spans
from textward.session import materialise
from textward.sources.tables import has_text, table

#: Up to so many given and family names each go to every worker; larger gazetteers are joined with the words of the texts.
NAMES = 50_000
#: A name enters the gazetteer when introduced this often.
TIMES = 2
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[NATIONAL_ID]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}
KINDS = ("request", "match")

# Frequent words that are no family names although they may follow a given name.
COMMON = frozenset(
    "the a an and or of in on at to for from with by is are was were be has have had do does can will not no this that these those my your his her our their it he she we you they i"
    " who what when where which how why if then than so but as street road avenue lane drive place court square station project team kit version handbook"
    " truly sincerely faithfully regards wishes"
    " grüßen grüssen cordialement saludos atentamente уважением"
    " der die das und oder ist sind von zu mit für auf im am le la les des et est sont de du un une el los las y es son en por para una и в на с по из не что как это".split()
)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """kind (0 request, 1 match), id, text of all deliveries with text."""
    a = requests(spark, folder).select(F.lit(0).alias("kind"), F.col("request_id").alias("id"), "text")
    m = table(spark, folder, "scan_matches").where(F.col("match_id").isNotNull() & has_text(F.col("matched_text")))
    return a.unionByName(m.select(F.lit(1).alias("kind"), F.col("match_id").alias("id"), F.col("matched_text").alias("text")))


def gazetteer(df: DataFrame, key: tuple) -> DataFrame:
    """name, given, family (BOOLEAN): all names that phrases introduce TIMES or more, written to the shared folder."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, seen = rewriter_of(key), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for given, family in introduced_names(rewrite(t)):
                    seen[0, given] += 1
                    seen[1, family] += 1
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int32()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["part", "name", "n"])

    counted = df.select("text").mapInArrow(find, "part int, name string, n long").groupBy("name")
    times = lambda part: F.sum(F.when(F.col("part") == part, F.col("n")).otherwise(0))
    names = counted.agg(times(0).alias("g"), times(1).alias("f")).where(F.greatest("g", "f") >= TIMES)
    names = names.select("name", *[F.when(F.col(c) >= TIMES, F.col(c)).otherwise(0).alias(c) for c in ("g", "f")])
    # a word counts as what it is introduced as more often
    return materialise(names.select("name", (F.col("g") > F.col("f")).alias("given"), (F.col("f") >= F.col("g")).alias("family")), "names")


def with_names(df: DataFrame, key: tuple, names: DataFrame) -> tuple[DataFrame, tuple | None]:
    """(kind, id, text, given, family of the texts; the whole gazetteer, if it is small enough for every worker).

    ``given`` and ``family`` list the known names among a text's words; they are null where the
    whole gazetteer is returned. Otherwise the words of each text meet the names by a hash join.
    """
    sizes = names.agg(F.count_if("given").alias("g"), F.count_if("family").alias("f")).first()
    if sizes.g <= NAMES and sizes.f <= NAMES:
        rows = names.collect()
        none = F.lit(None).cast("array<string>")
        whole = dict.fromkeys((r.name for r in rows if r.given), 1), dict.fromkeys((r.name for r in rows if r.family), 1)
        return df.select("kind", "id", "text", none.alias("given"), none.alias("family")), whole

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter_of(key)
        for batch in batches:
            out = [(kind, i, h, w) for kind, i, h, t in zip(*(batch.column(c).to_pylist() for c in range(4))) for w in name_words(rewrite(t))]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["kind", "id", "hash", "name"])

    by = ["kind", "id", "hash"]
    df = df.select("kind", "id", F.xxhash64("text").alias("hash"), "text")
    words = df.mapInArrow(split, "kind int, id long, hash long, name string").join(names, "name")
    pick = lambda c: F.collect_set(F.when(F.col(c), F.col("name"))).alias(c)
    known = words.groupBy(*by).agg(pick("given"), pick("family"))
    rows = df.join(known, by, "left")
    return rows.select("kind", "id", "text", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("given", "family")]), None


def _known(whole: tuple | None, given: list[str] | None, family: list[str] | None) -> tuple[dict[str, int], dict[str, int]]:
    """Given and family names for one text."""
    return whole if whole is not None else (dict.fromkeys(given, 1), dict.fromkeys(family, 1))


def candidates(df: DataFrame, key: tuple, names: DataFrame) -> DataFrame:
    """kind, id, pii_type (index into TYPES), key: one row per candidate span."""
    rows, whole = with_names(df, key, names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter_of(key)
        for batch in batches:
            out: list[tuple] = []
            for kind, i, t, g, f in zip(*(batch.column(c).to_pylist() for c in range(5))):
                out += [(kind, i, TYPES.index(s.kind), s.key) for s in spans(rewrite(t), *_known(whole, g, f), COMMON)]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["kind", "id", "pii_type", "key"])

    return rows.mapInArrow(find, "kind int, id long, pii_type int, key string")


def em(votes: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Probability that each vote pattern is a true span (two-class latent model).

    ``votes`` (patterns x labelers) holds -1, 0 and 1; labelers are independent given the truth.
    Starts from the balance of votes; a prior says that labelers are better than chance, so that
    true spans alone are not parted in two classes. One pattern or constant labelers are fine.
    """
    prob = 1 / (1 + np.exp(-1.5 * (votes.sum(axis=1) - 0.5)))
    trust = 0.3 * weight.sum() + 20
    for _ in range(rounds):
        score = np.zeros(len(votes))
        for sign, p, prior in ((1, prob, {1: 0.6, 0: 0.35, -1: 0.05}), (-1, 1 - prob, {1: 0.1, 0: 0.5, -1: 0.4})):
            w = weight * p
            total = w.sum()
            score += sign * np.log((total + trust) / (weight.sum() + 2 * trust))
            for j in range(votes.shape[1]):
                for v in (-1, 0, 1):
                    at = votes[:, j] == v
                    score[at] += sign * np.log((w[at].sum() + trust * prior[v] + 0.01) / (total + trust + 0.03))
        prob = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return prob


def fit(counts: list[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """(type, key) -> probability by the span classifier, from the number of candidates per key."""
    out: dict[tuple[int, str], float] = {}
    for kind in range(len(TYPES)):
        rows = [(k, n) for t, k, n in counts if t == kind]
        if not rows:
            continue
        weight = np.array([n for _, n in rows], dtype=float)
        votes = np.array([[int(v) for v in k.split("|")[0].split()] for k, _ in rows])
        soft = em(votes, weight)
        extra = np.array([[int(v) for v in k.split("|")[1].split()] for k, _ in rows], dtype=float)
        x = np.hstack([np.ones((len(rows), 1)), (votes == 1), (votes == -1), extra / 4]).astype(float)
        w = np.zeros(x.shape[1])
        # keys weigh as the root of their number, so that rare ones still teach
        share = np.sqrt(weight) / np.sqrt(weight).sum()
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (share * (soft - p)) - 1e-4 * w
            hess = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-4 * np.eye(len(w))
            w += np.linalg.solve(hess, grad)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        out.update({(kind, k): float(v) for (k, _), v in zip(rows, p)})
    return out


def model(spark: SparkSession, folder: str) -> tuple[DataFrame, tuple, DataFrame, dict[tuple[int, str], float]]:
    """(candidates written to the shared folder, frequencies, gazetteer, classifier)."""
    df = texts(spark, folder)
    key = counts_key(member_counts(df, "text"))
    names = gazetteer(df, key)
    spans_ = materialise(candidates(df, key, names), "spans")
    # as many rows as there are different keys: bounded by the vote alphabets
    counts = [(r.pii_type, r.key, r.n) for r in spans_.groupBy("pii_type", "key").agg(F.count(F.lit(1)).alias("n")).collect()]
    return spans_, key, names, fit(counts)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id, pii_type: one row per record and type that occurs in it."""
    spans_, _, _, score = model(spark, folder)
    kept = [(t, k) for (t, k), p in score.items() if p >= 0.5]
    good = spark.createDataFrame(kept or [(-1, "")], "pii_type int, key string")
    hits = spans_.join(F.broadcast(good), ["pii_type", "key"], "left_semi").select("kind", "id", "pii_type").distinct()
    names = F.array(*[F.lit(x) for x in TYPES])
    return hits.select(F.when(F.col("kind") == 0, KINDS[0]).otherwise(KINDS[1]).alias("record_kind"), F.col("id").alias("record_id"), F.get(names, F.col("pii_type")).alias("pii_type"))


def chosen(text: str, names: tuple, score: dict[tuple[int, str], float]) -> list[tuple[int, int, str]]:
    """Non-overlapping accepted spans of a consistent form, the most probable first, in order."""
    rated = [(score.get((TYPES.index(s.kind), s.key), 0.0), s) for s in spans(text, *names, COMMON)]
    out: list[tuple[int, int, str]] = []
    for p, s in sorted(((p, s) for p, s in rated if p >= 0.5), key=lambda x: (-x[0], x[1].start)):
        if all(s.end <= a or s.start >= b for a, b, _ in out):
            out.append((s.start, s.end, s.kind))
    return sorted(out)


def masked(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id, masked: the texts that hold personal information, with placeholders.

    The rest of a text stays as written. One row per record; deliveries repeat the text.
    """
    _, key, names, score = model(spark, folder)
    known, whole = with_names(texts(spark, folder), key, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter_of(key)
        for batch in batches:
            out = []
            for kind, i, t, g, f in zip(*(batch.column(c).to_pylist() for c in range(5))):
                form, places = rewrite.aligned(t)
                got, at, parts = chosen(form, _known(whole, g, f), score), 0, []
                for start, end, what in got:
                    start, end = places(start), places(end)
                    if start >= at:
                        parts += (t[at:start], PLACEHOLDER[what])
                        at = end
                if got:
                    out.append((KINDS[kind], i, "".join(parts) + t[at:]))
            types = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["record_kind", "record_id", "masked"])

    rows = known.mapInArrow(run, "record_kind string, record_id long, masked string")
    return rows.groupBy("record_kind", "record_id").agg(F.min("masked").alias("masked"))
