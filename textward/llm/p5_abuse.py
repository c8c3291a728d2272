"""Problem 5: a score for abusive, hateful or sexual language, with rates per source.

Words are looked up in a lexicon trie through Levenshtein automata, so that misspelled, masked,
stretched and spaced-out terms are found. The window around a hit tells abuse (aimed at a person or group) from quotation
and technical use; a logistic model, trained on the review labels and held near hand-set weights
where labels are few, turns the signs into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm.data import form_key, requests
from textward.llm.fuzzy_lexicon import FuzzyLexicon, fold
from textward.llm.lookalike import rewriter_of
from textward.session import materialise
from textward.sources.tables import table

#: A request with this score or more counts as abusive.
THRESHOLD = 0.5

# The lexicon, by kind and strength, in English, German, French, Spanish and Russian.
TERMS = {
    ("insult", 2): """idiot moron imbecile cretin halfwit dumbass loser scumbag bastard bitch parasite asshole arsehole dickhead wanker
        twat retard cunt whore slut motherfucker douchebag jackass nitwit dimwit scum shithead fuckwit degenerate vollidiot abschaum arschloch
        schlampe hure wichser missgeburt drecksau dreckskerl trottel connard connasse salope pute abruti enculé ordure crétin imbécile
        imbécil idiota gilipollas cabrón zorra pendejo maricón идиот дебил урод мразь сука тварь ублюдок придурок кретин ничтожество шлюха""",
    ("insult", 1): """clown fool stupid pathetic worthless useless brain braindead dead trash dumb shut mouth wertloser wertlos dumm fresse gueule
        inutile nul cállate inútil mierda никчёмный тупой заткнись rubbish""",
    ("group", 2): """vermin rats filth thief thieves subhuman subhumans cockroach cockroaches lice savages ungeziefer vermine basura твари""",
    ("group", 1): """animal animals breed human burn ruin driven allowed raus dehors echarlos гнать stupid""",
    ("threat", 2): """smash beaten strangle stab murder kill verprügelt umbringen abstechen убью зарежу""",
    ("threat", 1): """jump break fingers face die disappear bridge hurt burn choke""",
    ("sexual", 2): """porn porno hardcore horny naked fuck fucking fucked tits boobs pussy cock dick blowjob cum nackt geil ficken titten nue excité
        baiser desnuda desnudas tetas follar голые голая трахнуть секс порно""",
    ("sexual", 1): """nude ass arse sex wet babe filthy clothes shirt strip grab lick photos pictures фото""",
}
PLURALS = ("", "s", "es", "en")

_SECOND = frozenset("you your yours youre yourself u ur du dich dir dein deine deinen euch ihr tu te toi ta tes ton vous votre espece tú tu ti tus te eres usted ты тебя тебе твой твои твоя вы вас вам".split())
_THIRD = frozenset("they them their those these every all no hiring sie alle diese ils elles les ces tous ellos ellas los esos todos они их все эти".split())
_QUOTE = frozenset("word words policy policies moderator moderators novel called quoted quote quotes quotation dictionary plural meaning translate translation complaint reported fables tale spelling definition slur slurs speech slang etymology wort roman mot roman palabra novela слово роман".split())
_TECH = frozenset("process node bug thread server model engine eggs palette colour color kernel daemon task job script firmware village tale donkey donkeys".split())
_TOKEN = re.compile(r"[^\W_](?:[\w*@$!|+]*[\w*$])?|[.!?…;\n]")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:([ .*_-])[^\W_]){2,}(?:\1[^\W_]{2})?(?![^\W_])")
_STOPS = frozenset(".!?…;\n")
WINDOW = 14

# Signs of a request, with the weight each has before training.
SIGNS = (
    ("strong insult at someone", 3.5),
    ("strong insult at nobody", 0.3),
    ("strong insult quoted", -1.0),
    ("weak insults at someone", 1.5),
    ("weak insult otherwise", -0.5),
    ("group called vermin", 4.0),
    ("group run down", 3.5),
    ("threat at someone", 2.5),
    ("threat words otherwise", -0.5),
    ("explicit word at someone", 3.5),
    ("several explicit words", 3.5),
    ("explicit word alone", 0.5),
    ("explicit or sexual word quoted or technical", -1.0),
    ("suggestive words at someone", 2.0),
    ("only misspelled by a letter", -1.5),
)
BIAS = -3.0


def build_lexicon() -> FuzzyLexicon:
    """Terms with the kinds they belong to; plural and case endings are added."""
    kinds: dict[str, dict[str, int]] = {}
    for (kind, strength), words in TERMS.items():
        for word in words.split():
            for end in PLURALS if strength == 2 and len(word) > 3 else ("",):
                kinds.setdefault(fold(word) + end, {}).setdefault(kind, strength)
    near = {fold(word) for (_, strength), words in TERMS.items() if strength == 2 for word in words.split()}
    return FuzzyLexicon({word: tuple(sorted(k.items())) for word, k in kinds.items()}, near)


def signs(text: str, lexicon: FuzzyLexicon) -> int:
    """Bit mask of SIGNS of a text in consistent form."""
    text = text.lower()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: " " + re.sub(r"[ .*_-]", "", m.group()) + " ", text)
    tokens = _TOKEN.findall(text)
    known, match = lexicon.known, lexicon.match
    hits = []
    for i, token in enumerate(tokens):
        hit = known[token] if token in known else match(token)
        if hit is not None:
            hits.append((i, hit))
    if not hits:
        return 0
    mask, exact, near = 0, False, False
    # hits of one sentence no more than a window apart are judged together
    bunch: list[tuple[int, tuple]] = []
    bunches = []
    for i, hit in hits:
        if bunch and (i - bunch[-1][0] > WINDOW or not _STOPS.isdisjoint(tokens[bunch[-1][0] : i])):
            bunches.append(bunch)
            bunch = []
        bunch.append((i, hit))
    bunches.append(bunch)
    for bunch in bunches:
        low, high = bunch[0][0], bunch[-1][0]
        a = low
        while a > 0 and low - a < WINDOW and tokens[a - 1] not in _STOPS:
            a -= 1
        b = high + 1
        while b < len(tokens) and b - high < WINDOW and tokens[b] not in _STOPS:
            b += 1
        around = {fold(t) for t in tokens[a:b]}
        second, third = not _SECOND.isdisjoint(around), not _THIRD.isdisjoint(around)
        quote, tech = not _QUOTE.isdisjoint(around), not _TECH.isdisjoint(around)
        count: dict[tuple[str, int], int] = {}
        for _, (value, errors) in bunch:
            exact, near = exact or errors == 0, near or errors > 0
            for key in value:
                count[key] = count.get(key, 0) + 1
        strong = count.get(("insult", 2), 0)
        weak = count.get(("insult", 1), 0)
        explicit, suggestive = count.get(("sexual", 2), 0), count.get(("sexual", 1), 0)
        vermin, down = count.get(("group", 2), 0), count.get(("group", 1), 0)
        threat, harm = count.get(("threat", 2), 0), count.get(("threat", 1), 0)
        plain = not quote and not (tech and not second)
        aimed = second or third
        mask |= (1 << 0) * bool(strong and aimed and plain)
        mask |= (1 << 1) * bool(strong and not aimed and plain)
        mask |= (1 << 2) * bool(strong and not plain)
        mask |= (1 << 3) * bool(weak > 1 and second and plain)
        mask |= (1 << 4) * bool(weak and not (weak > 1 and second and plain))
        mask |= (1 << 5) * bool(vermin and aimed and plain)
        mask |= (1 << 6) * bool(down > (0 if vermin else 1) and aimed and plain or down and third and plain and vermin + strong + weak > 0)
        mask |= (1 << 7) * bool((threat or harm > 1) and second and plain and threat + harm > 1)
        mask |= (1 << 8) * bool((threat or harm) and not (second and plain))
        mask |= (1 << 9) * bool(explicit and second and plain)
        mask |= (1 << 10) * bool((explicit > 1 or explicit and suggestive) and plain)
        mask |= (1 << 11) * bool(explicit == 1 and not second and not suggestive and plain)
        mask |= (1 << 12) * bool((explicit or suggestive) and not plain)
        mask |= (1 << 13) * bool(suggestive and second and plain)
    # every hit was a near miss
    return mask | (1 << 14) * (near and not exact)


def marks(df: DataFrame, key: tuple) -> DataFrame:
    """request_id, source, mask: one row per request (the earliest delivery's source, nulls last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, lexicon = rewriter_of(key), build_lexicon()
        for batch in batches:
            masks = [signs(rewrite(t), lexicon) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(masks, pa.int32())], ["request_id", "source", "received_at", "mask"])

    rows = df.select("request_id", "source", "received_at", "text").mapInArrow(run, "request_id long, source string, received_at timestamp, mask int")
    first = F.min(F.struct(F.col("received_at").isNull(), "received_at", F.col("source").isNull(), "source", "mask")).alias("x")
    return rows.groupBy("request_id").agg(first).select("request_id", "x.source", "x.mask")


def train(rows: list[tuple[int, float, float]], pull: float = 2.0) -> np.ndarray:
    """Weights (bias last) from (mask, positive, total) counts; ``pull`` holds them near the hand-set ones."""
    start = np.array([w for _, w in SIGNS] + [BIAS])
    if not rows:
        return start
    x = np.array([[(m >> j) & 1 for j in range(len(SIGNS))] + [1] for m, _, _ in rows], dtype=float)
    good, total = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2))
    w = start.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (good - total * p) - pull * (w - start)
        hess = (x * (total * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, source, score (0..1, higher is more abusive) of every request with text."""
    seen = materialise(marks(requests(spark, folder), form_key(spark, folder)), "marks")
    labels = table(spark, folder, "review_labels").where("abusive IS NOT NULL").groupBy("request_id").agg(F.avg("abusive").alias("y"))
    # masks are few (at most 2^15), so counts per mask come to the driver
    taught = seen.join(labels, "request_id").groupBy("mask").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    w = train([(r["mask"], r["good"], r["n"]) for r in taught])
    value = F.lit(float(w[-1]))
    for j in range(len(SIGNS)):
        value = value + F.getbit("mask", F.lit(j)).cast("double") * float(w[j])
    return seen.select("request_id", "source", (1 / (1 + F.exp(-value))).alias("score"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """request_id of the requests that reach the threshold."""
    return scores(spark, folder).where(F.col("score") >= THRESHOLD).select("request_id")


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """source (null for unknown), requests, abusive, rate, mean_score."""
    rows = scores(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("requests"), F.sum((F.col("score") >= THRESHOLD).cast("long")).alias("abusive"), F.avg("score").alias("mean_score"))
    return rows.select("source", "requests", "abusive", (F.col("abusive") / F.col("requests")).alias("rate"), "mean_score")
