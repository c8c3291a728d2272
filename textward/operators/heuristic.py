"""Signatures compiled to Column expressions over the normalised text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions.normalize import sql_string
from textward.functions.regex import BEYOND, java_pattern, required, slow_search
from textward.sources.catalog import Pattern, Signature

#: A match; the offset and the length count bytes of the scanned (normalised) text.
MATCH = (
    "struct<signature_id:string,engine:string,matched_text:string,score:double,confidence:double,severity:double,"
    "match_offset:bigint,match_length:bigint>"
)
#: What a pattern finds: the text, and the bytes before it.
HIT = "struct<t:string,o:bigint>"


def usable(pattern: Pattern) -> bool:
    """Patterns of other types never match here."""
    return pattern.type in ("regex", "substring") and bool(pattern.value)


def expression(pattern: Pattern) -> tuple[str, bool]:
    """(JVM pattern, whether it is safe on long texts) of a regex (Unicode case folding) or a literal (ASCII case folding)."""
    return java_pattern(pattern.value) if pattern.type == "regex" else ("(?i)" + re.escape(pattern.value), True)


def guard(pattern: Pattern, text: str, low: str) -> str | None:
    """A cheap SQL test that every text with a match passes, on the text and its lower case."""
    if pattern.type == "substring":
        tests = [[pattern.value.lower()] if pattern.value.isascii() else [BEYOND]]
    else:
        tests = required(pattern.value)
    if not tests:
        return None
    beyond = f"octet_length({text}) > length({text})"
    one = lambda w: beyond if w == BEYOND else f"contains({low}, {sql_string(w)})"
    return " AND ".join("(" + " OR ".join(map(one, words)) + ")" for words in tests)


def slow_patterns(signatures: list[Signature]) -> list[str]:
    """Patterns the JVM could not run on texts of any length."""
    return sorted({p.value for s in signatures for p in s.patterns if usable(p) and not expression(p)[1]})


def slow_hits(patterns: list[str]) -> Column | None:
    """ARRAY<HIT> of such patterns, in order, by Python's regular expressions, which take no stack; null without any."""

    @F.pandas_udf(f"array<{HIT}>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out = []
            for text in part:
                found = [slow_search(p, text or "") for p in patterns]
                out.append([None if f is None else {"t": f[0], "o": len(text[: f[1]].encode())} for f in found])
            yield pd.Series(out, dtype=object)

    return run if patterns else None


def pattern_hit(pattern: Pattern, text: str, low: str, slow: list[str] = ()) -> str:
    """SQL of the first match of a pattern as HIT, null without one (an empty match counts).

    ``slow`` lists the patterns whose hits are in the column ``__slow``.
    """
    java, _ = expression(pattern)
    if pattern.type == "regex" and pattern.value in slow:
        return f"get(__slow, {slow.index(pattern.value)})"
    found, before = sql_string(java), sql_string(f"(?s)\\A(.*?)(?-s:{java})")
    test = guard(pattern, text, low)
    only = f"{test} AND " if test else ""
    hit = f"named_struct('t', regexp_extract({text}, {found}, 0), 'o', CAST(octet_length(regexp_extract({text}, {before}, 1)) AS BIGINT))"
    return f"CASE WHEN {only}{text} RLIKE {found} THEN {hit} END"


def signature_hit(signature: Signature, text: str, low: str, slow: list[str] = ()) -> str:
    """SQL of the HIT of a signature, or null: that of the first pattern in order that matches.

    With condition ``all`` every pattern must match, and patterns of other types never do.
    """
    patterns = [p for p in signature.patterns if usable(p)]
    if not patterns or signature.condition == "all" and len(patterns) < len(signature.patterns):
        return f"CAST(NULL AS {HIT})"
    hits = [pattern_hit(p, text, low, slow) for p in patterns]
    if signature.condition == "all":
        every = " AND ".join(f"({h}) IS NOT NULL" for h in hits)
        return f"CASE WHEN {every} THEN {hits[0]} END"
    return f"coalesce({', '.join(hits)})"


def direction_test(signature: Signature, side: str) -> str:
    """SQL: whether a signature runs on a text of the direction in column ``side`` (all do where it is null)."""
    if signature.direction == "bidirectional":
        return "true"
    return f"coalesce({side}, {sql_string(signature.direction)}) = {sql_string(signature.direction)}"


def matches_sql(signatures: list[tuple[Signature, float]], text: str, low: str, side: str | None = None, slow: list[str] = (), chunk: int = 10) -> str:
    """SQL of ARRAY<MATCH> of the signatures that hit; see :func:`matches`."""
    parts = []
    for at in range(0, len(signatures), chunk):
        tried = []
        for s, points in signatures[at : at + chunk]:
            c, hit = s.base_confidence, signature_hit(s, text, low, slow)
            if side:
                hit = f"CASE WHEN {direction_test(s, side)} THEN {hit} END"
            tried.append(f"named_struct('signature_id', {sql_string(s.id)}, 'hit', {hit}, 'score', {c * points!r}D, 'confidence', {c!r}D, 'severity', {float(points)!r}D)")
        parts.append(f"filter(array({', '.join(tried)}), m -> m.hit IS NOT NULL)")
    if not parts:
        return f"CAST(array() AS array<{MATCH}>)"
    shown = (
        "named_struct('signature_id', m.signature_id, 'engine', 'heuristic', 'matched_text', m.hit.t, 'score', m.score, 'confidence', m.confidence, "
        "'severity', m.severity, 'match_offset', m.hit.o, 'match_length', CAST(octet_length(m.hit.t) AS BIGINT))"
    )
    return f"CAST(transform(IF(length({text}) > 0, flatten(array({', '.join(parts)})), array()), m -> {shown}) AS array<{MATCH}>)"


def matches(signatures: list[tuple[Signature, float]], text: str, low: str, side: str | None = None, slow: list[str] = (), chunk: int = 10) -> Column:
    """ARRAY<MATCH> of the signatures that hit, in order; ``signatures`` come with their points.

    ``text`` and ``low`` name the columns of the normalised text and its lower case, ``side`` that of
    the direction, where a table holds both. Built as one SQL expression (parsed once), in chunks of
    signatures so that generated methods stay small; an empty text has no hits.
    """
    return F.expr(matches_sql(signatures, text, low, side, slow, chunk))
