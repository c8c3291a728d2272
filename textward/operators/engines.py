"""Classifier, semantic, judge and composite engines that plug into the scanner.

Models are not shipped. A classifier is any function of a list of texts that gives
(confidence, label) pairs: one trained here, or an ONNX model in a local folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.operators.heuristic import MATCH
from textward.operators.scoring import score_v1
from textward.sources.catalog import Signature

Scorer = Callable[[list[str]], list[tuple[float, str]]]
NONE = f"array<{MATCH}>"

# Fixed values.
BENIGN = ("BENIGN", "SAFE", "LEGIT", "benign", "safe", "not_toxic", "neutral")
LEAST_CONFIDENCE = 0.5
ASSUMED_CONFIDENCE = 0.70
SHOWN = 100
BAND = (4.0, 9.0)
JUDGED = 1000
VERDICTS = {"UNSAFE": 0.95, "LIKELY_UNSAFE": 0.75, "AMBIGUOUS": 0.50, "LIKELY_SAFE": 0.25, "SAFE": 0.05}
JUDGE_ID, JUDGE_POINTS = "LLM-JUDGE-001", 10.0


def _made(ident: str, engine: str, shown: Column, score: Column, confidence: Column, severity: float, text: str) -> Column:
    """A match on a whole text."""
    fields = {"signature_id": F.lit(ident), "engine": F.lit(engine), "matched_text": shown, "score": score, "confidence": confidence, "severity": F.lit(severity)}
    whole = {"match_offset": F.lit(0), "match_length": F.octet_length(text)}
    return F.struct(*[c.alias(n) for n, c in (fields | whole).items()]).cast(MATCH)


def model_of(signature: Signature) -> str:
    """The model a classifier signature is sent to."""
    return signature.model or ("toxicity" if signature.category == "content-safety" else "injection")


class BagClassifier:
    """Logistic regression on hashed words; trained on a bounded sample of labelled rows."""

    def __init__(self, weights: np.ndarray, positive: str, negative: str = "BENIGN") -> None:
        self.weights, self.positive, self.negative = weights, positive, negative

    @staticmethod
    def features(texts: list[str], size: int) -> np.ndarray:
        import zlib

        x = np.zeros((len(texts), size + 1))
        x[:, size] = 1
        for i, t in enumerate(texts):
            for word in (t or "").lower().split():
                x[i, zlib.crc32(word.strip(".,;:!?\"'()").encode()) % size] = 1
        return x

    @classmethod
    def train(cls, labelled: DataFrame, text: str, label: str, positive: str, size: int = 1024, rows: int = 5000, rounds: int = 200) -> BagClassifier:
        """From a table of texts and 0/1 labels; ``rows`` bounds the sample (ordered by a hash of the text)."""
        sample = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("y")).orderBy(F.xxhash64("t"), "y").limit(rows).collect()
        w = np.zeros(size + 1)
        if sample:
            x, y = cls.features([r.t for r in sample], size), np.array([float(r.y) for r in sample])
            for _ in range(rounds):
                w += 0.5 * (x.T @ (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))) / len(y) - 1e-4 * w)
        return cls(w, positive)

    def __call__(self, texts: list[str]) -> list[tuple[float, str]]:
        p = 1 / (1 + np.exp(-np.clip(self.features(texts, len(self.weights) - 1) @ self.weights, -30, 30)))
        return [(float(v), self.positive) if v >= 0.5 else (float(1 - v), self.negative) for v in p]


class OnnxClassifier:
    """An ONNX sequence classifier with its tokenizer in a local folder, loaded once per worker."""

    def __init__(self, folder: str, batch: int = 32) -> None:
        self.folder, self.batch = folder, batch
        self._loaded = None

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "batch": self.batch, "_loaded": None}

    @staticmethod
    def available(folder: str | Path) -> bool:
        root = Path(folder)
        return (root / "tokenizer.json").is_file() and ((root / "model.onnx").is_file() or (root / "onnx" / "model.onnx").is_file())

    def _load(self):
        import onnxruntime
        from tokenizers import Tokenizer

        root = Path(self.folder)
        path = root / "model.onnx" if (root / "model.onnx").is_file() else root / "onnx" / "model.onnx"
        labels = {0: "BENIGN", 1: "INJECTION"}
        if (root / "config.json").is_file():
            labels = {int(k): v for k, v in json.loads((root / "config.json").read_text()).get("id2label", {}).items()} or labels
        self._loaded = (onnxruntime.InferenceSession(str(path)), Tokenizer.from_file(str(root / "tokenizer.json")), labels)
        return self._loaded

    def __call__(self, texts: list[str]) -> list[tuple[float, str]]:
        session, tokenizer, labels = self._loaded or self._load()
        names = {i.name for i in session.get_inputs()}
        tokenizer.enable_padding()
        out = []
        for at in range(0, len(texts), self.batch):
            coded = tokenizer.encode_batch(texts[at : at + self.batch])
            feed = {"input_ids": [x.ids for x in coded], "attention_mask": [x.attention_mask for x in coded], "token_type_ids": [x.type_ids for x in coded]}
            logits = session.run(None, {k: np.array(v, dtype=np.int64) for k, v in feed.items() if k in names})[0]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            out += [(float(row.max()), labels.get(int(row.argmax()), str(int(row.argmax())))) for row in p]
        return out


def _scored(scorer: Scorer, texts: list[str]) -> list[tuple[float | None, str | None]]:
    """Results of a scorer; a batch that fails is halved, so that only the text at fault has none."""
    if not texts:
        return []
    try:
        return list(scorer(texts))
    except Exception:  # noqa: BLE001  (a broken model must not end a scan)
        if len(texts) == 1:
            return [(None, None)]
        half = len(texts) // 2
        return _scored(scorer, texts[:half]) + _scored(scorer, texts[half:])


def infer(scorer: Scorer, text: Column) -> Column:
    """STRUCT<confidence, label> of a text by a scorer; null where it fails or the text is null or empty."""
    kind = T.StructType([T.StructField("confidence", T.DoubleType()), T.StructField("label", T.StringType())])

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list = [(None, None)] * len(part)
            at = [i for i, t in enumerate(part) if t]
            for i, pair in zip(at, _scored(scorer, [part.iloc[i] for i in at])):
                out[i] = pair
            yield pd.DataFrame(out, columns=["confidence", "label"])

    return run(text)


def classifier_engine(models: dict[str, Scorer]):
    """Engine of classifier signatures: each model runs once per text, whatever the number of its signatures."""

    def engine(df: DataFrame, text: str, signatures: list[tuple[Signature, float]]) -> Column:
        parts = []
        for name, scorer in models.items():
            own = [(s, p) for s, p in signatures if model_of(s) == name]
            if not own:
                continue
            # bound once through an array, so that a model is not run once per signature
            result = F.array(infer(scorer, F.col(text)))

            parts.append(F.flatten(F.transform(result, _hits_of(own, text))))
        return F.concat(*parts) if parts else F.array().cast(NONE)

    return engine


def _hits_of(own: list[tuple[Signature, float]], text: str):
    def build(r: Column) -> Column:
        sure = F.when(r["confidence"] == 0, F.lit(ASSUMED_CONFIDENCE)).otherwise(r["confidence"])
        made = [_made(s.id, "classifier", F.left(F.col(text), F.lit(SHOWN)), sure * p, sure, p, text) for s, p in own]
        hit = r["confidence"].isNotNull() & ~r["label"].isin(*BENIGN) & (r["confidence"] >= LEAST_CONFIDENCE)
        return F.when(hit, F.array(*made)).otherwise(F.array().cast(NONE))

    return build


def semantic_engine(index, vector: str, thresholds: dict[str, float] | None = None, default: float = 0.75):
    """Engine of semantic signatures over a column of embedding vectors and a phrase index."""

    def engine(df: DataFrame, text: str, signatures: list[tuple[Signature, float]]) -> Column:
        near = index.nearest(vector)
        limits = {s.id: next((p.similarity_threshold for p in s.patterns if p.similarity_threshold is not None), default) for s, _ in signatures} | (thresholds or {})
        def best(n: Column, s: Signature, points: float) -> Column:
            sim = F.array_max(F.transform(F.filter(n, lambda x: x["label"] == s.id), lambda x: x["similarity"]))
            made = _made(s.id, "semantic", F.format_string("semantic similarity=%.3f", sim), sim * points, sim, points, text)
            return F.when((sim > 0) & (sim >= limits[s.id]), F.array(made)).otherwise(F.array().cast(NONE))

        if not signatures:
            return F.array().cast(NONE)
        return F.flatten(F.transform(F.array(near), lambda n: F.concat(*[best(n, s, p) for s, p in signatures])))

    return engine


def composite(*columns: Column) -> Column:
    """The matches of several engines, one after another."""
    return F.concat(*columns)


def verdict(answer: Column) -> Column:
    """Confidence of a judge's answer; the first name found in the order of VERDICTS counts, else AMBIGUOUS.

    UNSAFE is tried first, so LIKELY_UNSAFE counts as UNSAFE.
    """
    upper = F.upper(F.coalesce(answer, F.lit("")))
    out = F.when(upper.contains("UNSAFE"), VERDICTS["UNSAFE"])
    for name in ("LIKELY_SAFE", "SAFE"):
        out = out.when(upper.contains(name), VERDICTS[name])
    return out.otherwise(VERDICTS["AMBIGUOUS"])


def in_band(matches: Column, low: float = BAND[0], high: float = BAND[1]) -> Column:
    """Whether the sum of scores is ambiguous, ends included."""
    return score_v1(matches).between(low, high)


def judge(ask: Callable[[list[str]], list[str]], low: float = BAND[0], high: float = BAND[1]):
    """A judge for the scanner: asked about the ambiguous texts only, the other rows pass by."""

    def apply(df: DataFrame, text: str, matches: str) -> DataFrame:
        @F.pandas_udf(T.StringType())
        def answers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                at = [i for i, t in enumerate(part) if t is not None]
                out: list = [None] * len(part)
                for i, answer in zip(at, ask([part.iloc[i][:JUDGED] for i in at]) if at else []):
                    out[i] = answer
                yield pd.Series(out, dtype=object)

        band = F.coalesce(in_band(F.col(matches), low, high), F.lit(False))
        asked = df.withColumn("__sure", verdict(answers(F.when(band, F.coalesce(text, F.lit(""))))))
        shown = F.left(F.col(text), F.lit(SHOWN))
        made = _made(JUDGE_ID, "llm-judge", shown, F.col("__sure") * JUDGE_POINTS, F.lit(0.0), 0.0, text)
        unsafe = band & (F.col("__sure") >= VERDICTS["LIKELY_UNSAFE"])
        return asked.withColumn(matches, F.when(unsafe, F.concat(F.col(matches), F.array(made))).otherwise(F.col(matches))).drop("__sure")

    return apply
