"""Functions for SQL: guard_normalize, guard_decode, guard_entropy, guard_score, guard_decision, guard_found, guard_matches, guard_explain."""

from __future__ import annotations

import base64
import binascii
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.functions import normalize as n
from textward.operators import heuristic
from textward.operators.heuristic import MATCH
from textward.operators.scoring import CORROBORATION, ScoringPolicy
from textward.plans.scan import Scanner

_INVISIBLE = {ord(c): None for c in n.INVISIBLE}
_LOOKALIKE = {ord(a): b for a, b in zip(n.LOOKALIKE_FROM, n.LOOKALIKE_TO)}
_ROT = str.maketrans(n.ROT_FROM, n.ROT_TO)


def _english(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in n.ENGLISH_MARKS)


def _base64(text: str) -> str | None:
    body = text.strip()
    if len(body) < 4 or not re.fullmatch(r"[A-Za-z0-9+/=\s]+", body):
        return None
    packed = re.sub(r"\s", "", body)
    try:
        raw = base64.b64decode(packed, validate=True)
        return raw.decode() if base64.b64encode(raw).decode() == packed else None
    except (binascii.Error, UnicodeDecodeError):
        return None


def _hex(text: str) -> str | None:
    body = text.strip()
    if len(body) < 8 or len(body) % 2 or not re.fullmatch("[0-9A-Fa-f]+", body):
        return None
    try:
        return bytes.fromhex(body).decode()
    except UnicodeDecodeError:
        return None


def decode(text: str) -> tuple[str, list[str]]:
    """(text, encodings) after undoing encodings of the whole text; see functions.normalize.decode."""
    most, found = len(text.encode()) * n.MAX_AMPLIFICATION, []
    for _ in range(n.MAX_DEPTH):
        for name, out in (("base64", _base64(text)), ("hex", _hex(text))):
            if out is not None and len(out.encode()) <= most and out != text:
                text = out
                found.append(name)
                break
        else:
            turned = text.translate(_ROT)
            if _english(turned) and not _english(text):
                return turned, [*found, "rot13"]
            break
    return text, found


def normalise(text: str | None) -> str:
    """The normalised text of one string."""
    raw = (text or "").encode()
    if len(raw) > n.MAX_BYTES:
        text = raw[: n.MAX_BYTES].decode(errors="ignore")
    text = unicodedata.normalize("NFKC", (text or "").translate(_INVISIBLE)).translate(_INVISIBLE)
    return decode(text.translate(_LOOKALIKE))[0]


def entropy(text: str | None) -> float:
    """Bits a byte."""
    raw = (text or "").encode()
    return -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values()) + 0.0 if raw else 0.0


def score(matches) -> float:
    """Score of a list of rows with signature_id, score, confidence, severity."""
    rows = list(matches if matches is not None else [])
    if not rows:
        return 0.0
    at = max(range(len(rows)), key=lambda i: (rows[i]["score"], i))
    rest = [m for i, m in enumerate(rows) if i != at and m["signature_id"] != rows[at]["signature_id"]]
    return rows[at]["score"] + sum(m["confidence"] * CORROBORATION * rows[at]["severity"] / (1 + r) for r, m in enumerate(rest))


def _matches_sql(scanner: Scanner) -> str:
    """SQL of the matches of ``text`` under the scanner's policy, the expression a scan runs; patterns unsafe for the JVM are left out."""
    chosen = [(s, p) for s, p in scanner.signatures(None, "heuristic") if not heuristic.slow_patterns([s])]
    inner = heuristic.matches_sql(chosen, "x.t", "x.low", "x.side")
    bound = "named_struct('t', guard_normalize(text), 'low', lower(guard_normalize(text)), 'side', IF(direction IN ('input', 'output'), direction, NULL))"
    return f"element_at(transform(array({bound}), x -> {inner}), 1)"


def register(spark: SparkSession, policy: ScoringPolicy = ScoringPolicy(), scanner: Scanner | None = None) -> list[str]:
    """Register the functions; gives their names."""

    def texts(f, kind):
        @F.pandas_udf(kind)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([f(t) for t in part], dtype=object if kind != T.DoubleType() else float)

        return run

    spark.udf.register("guard_normalize", texts(normalise, T.StringType()))
    spark.udf.register("guard_decode", texts(lambda t: decode(t or "")[0], T.StringType()))
    spark.udf.register("guard_entropy", texts(entropy, T.DoubleType()))
    spark.udf.register("guard_score", texts(score, T.DoubleType()))
    shown = _matches_sql(scanner or Scanner())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION guard_found(text STRING, direction STRING) RETURNS ARRAY<{MATCH}> RETURN {shown}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION guard_matches(text STRING, direction STRING) RETURNS ARRAY<STRING> "
        "RETURN transform(guard_found(text, direction), m -> m.signature_id)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION guard_explain(text STRING, direction STRING) "
        "RETURNS TABLE (signature_id STRING, matched_text STRING, score DOUBLE, match_offset BIGINT, match_length BIGINT) "
        "RETURN SELECT m.signature_id, m.matched_text, m.score, m.match_offset, m.match_length FROM (SELECT guard_found(text, direction) AS a) LATERAL VIEW explode(a) e AS m"
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION guard_decision(score DOUBLE, direction STRING) RETURNS STRING RETURN
        CASE WHEN score >= IF(direction = 'input', {policy.inbound_block}, {policy.outbound_block}) THEN 'block'
             WHEN score >= IF(direction = 'input', {policy.inbound_flag}, {policy.outbound_flag}) THEN 'flag' ELSE 'allow' END"""
    )
    return ["guard_normalize", "guard_decode", "guard_entropy", "guard_score", "guard_found", "guard_matches", "guard_decision", "guard_explain"]
