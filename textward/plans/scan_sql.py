"""The scanner as SQL for an engine with RE2 (linear regular expressions): what the scanner's queries are checked against.

Written from the same catalog, in other means: relational normalisation, one SELECT per
signature, joins instead of arrays.
"""

from __future__ import annotations

import re
import sys
import unicodedata

from textward.functions import normalize as n
from textward.functions.regex import BLANK, re2_pattern, word_class
from textward.operators.heuristic import usable
from textward.sources.catalog import Pattern, Signature


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def compatibility() -> str:
    """VALUES of all characters whose compatibility form is not their canonical one, with that form."""
    rows = []
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", ch)
        if plain != unicodedata.normalize("NFD", ch):
            rows.append(f"({quote(ch)},{quote(plain)})")
    return ",".join(rows)


ENGLISH = "regexp_matches(lower({}), '" + "|".join(n.ENGLISH_MARKS) + "')"
WIDE = "".join(chr(o) for o in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])


def lookalikes(text: str) -> str:
    return f"translate({text}, {quote(n.LOOKALIKE_FROM + WIDE)}, {quote(n.LOOKALIKE_TO + ''.join(chr(ord(c) - 0xFEE0) for c in WIDE))})"


def rot13(text: str) -> str:
    return f"translate({text}, {quote(n.ROT_FROM)}, {quote(n.ROT_TO)})"


def stripped(text: str) -> str:
    return f"translate({text}, {quote(n.INVISIBLE)}, '')"


def count_of(text: str, chars: str) -> str:
    return f"length({text}) - length(translate({text}, {quote(chars)}, ''))"


def nfkc_ctes(source: str, text: str, out: str) -> str:
    """CTEs ending in ``out`` (key, form): the compatibility form of a column of ``source`` (key unique)."""
    return f"""{out}_p AS (SELECT key, unnest(l) AS c, unnest(range(len(l))) AS i FROM (
      SELECT key, regexp_extract_all({text}, '(?s).') AS l FROM {source} WHERE regexp_matches({text}, '[^\\x00-\\x7F]'))),
    {out}_k(c, r) AS (VALUES {compatibility()}),
    {out}_j AS (SELECT key, string_agg(coalesce(r, c), '' ORDER BY i) AS form FROM {out}_p LEFT JOIN {out}_k USING (c) GROUP BY key),
    {out} AS MATERIALIZED (SELECT s.key, nfc_normalize(coalesce(j.form, s.{text})) AS form FROM {source} s LEFT JOIN {out}_j j USING (key))"""


def decode_ctes(source: str, out: str) -> str:
    """CTEs ending in ``out`` (key, t, enc): up to MAX_DEPTH encodings of the column ``t`` of ``source`` undone."""
    parts = [f"{out}_0 AS (SELECT key, t, octet_length(encode(t)) * {n.MAX_AMPLIFICATION} AS lim, []::VARCHAR[] AS enc, false AS stop FROM {source})"]
    for level in range(1, n.MAX_DEPTH + 1):
        last = f"{out}_{level - 1}"
        parts.append(
            f"""{out}_{level}a AS (SELECT *, trim(t, {quote(n.BLANKS)}) AS body, translate(trim(t, {quote(n.BLANKS)}), {quote(n.BLANKS)}, '') AS packed FROM {last}),
    {out}_{level}b AS (SELECT *,
      CASE WHEN NOT stop AND octet_length(encode(body)) >= 4 AND regexp_full_match(body, '[A-Za-z0-9+/=\\t-\\r {BLANK}]+') AND length(packed) % 4 = 0
            AND to_base64(TRY(from_base64(packed))) = packed THEN TRY(decode(from_base64(packed))) END AS b,
      CASE WHEN NOT stop AND length(body) >= 8 AND length(body) % 2 = 0 AND regexp_full_match(body, '[0-9A-Fa-f]+') THEN TRY(decode(unhex(body))) END AS h,
      {rot13('t')} AS r FROM {out}_{level}a),
    {out}_{level}c AS (SELECT *, CASE WHEN stop THEN '' WHEN b IS NOT NULL AND b <> t AND octet_length(encode(b)) <= lim THEN 'base64'
      WHEN h IS NOT NULL AND h <> t AND octet_length(encode(h)) <= lim THEN 'hex' WHEN {ENGLISH.format('r')} AND NOT {ENGLISH.format('t')} THEN 'rot13' ELSE '' END AS how
      FROM {out}_{level}b),
    {out}_{level} AS MATERIALIZED (SELECT key, CASE how WHEN 'base64' THEN b WHEN 'hex' THEN h WHEN 'rot13' THEN r ELSE t END AS t, lim,
      CASE WHEN how = '' THEN enc ELSE list_append(enc, how) END AS enc, stop OR how NOT IN ('base64', 'hex') AS stop FROM {out}_{level}c)"""
        )
    return ",\n    ".join(parts) + f",\n    {out} AS (SELECT key, t, enc FROM {out}_{n.MAX_DEPTH})"


def normal_ctes(source: str) -> str:
    """CTEs ending in ``norm`` (key, t, enc, invisible, mapped, truncated) of a CTE with key and text."""
    return f"""n_a AS MATERIALIZED (SELECT key, coalesce(text, '') AS a, {stripped("coalesce(text, '')")} AS s FROM {source}),
    {nfkc_ctes('n_a', 's', 'n_f')},
    n_c AS MATERIALIZED (SELECT key, {stripped('form')} AS b, {lookalikes(stripped('form'))} AS t FROM n_f),
    {decode_ctes('n_c', 'n_d')},
    norm AS MATERIALIZED (SELECT d.key, d.t, d.enc, {count_of('a.a', n.INVISIBLE)} AS invisible, c.b <> c.t AS mapped,
      octet_length(encode(a.a)) > {n.MAX_BYTES} AS truncated FROM n_d d JOIN n_a a USING (key) JOIN n_c c USING (key))"""


def _value(pattern: Pattern) -> str:
    return pattern.value if pattern.type == "regex" else re.sub(r"([^\w\s])", r"\\\1", pattern.value)


def hit_ctes(signatures: list[tuple[Signature, float]], sides: str) -> str:
    """CTEs ending in ``hits`` (key, ord, signature_id, matched_text, match_offset, match_length, score, confidence, severity).

    Reads ``norm``; ``sides`` is a CTE of key and side (null: signatures of both directions run).
    """
    selects = []
    for at, (s, points) in enumerate(signatures):
        patterns = [re2_pattern(_value(p)) for p in s.patterns if usable(p)]
        if not patterns or s.condition == "all" and len(patterns) < len(s.patterns):
            continue
        tests = [f"regexp_matches({'t' if p.plain else 'u'}, {quote(p.test())})" for p in patterns]
        heads = [f"length(regexp_extract({'t' if p.plain else 'u'}, {quote(p.head())}, 1))" for p in patterns]
        sizes = [f"length(regexp_extract({'t' if p.plain else 'u'}, {quote(p.match())}, 1))" for p in patterns]
        which = f"CASE WHEN {' AND '.join(tests)} THEN 0 END" if s.condition == "all" else "CASE " + " ".join(f"WHEN {x} THEN {i}" for i, x in enumerate(tests)) + " END"
        pick = lambda parts: "CASE which " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(parts)) + " END"
        side = "true" if s.direction == "bidirectional" else f"coalesce(side, {quote(s.direction)}) = {quote(s.direction)}"
        selects.append(
            f"SELECT key, {at} AS ord, {quote(s.id)} AS signature_id, t, {pick(heads)} AS pre, {pick(sizes)} AS size, {s.base_confidence * points!r}::DOUBLE AS score, "
            f"{s.base_confidence!r}::DOUBLE AS confidence, {float(points)!r}::DOUBLE AS severity FROM (SELECT *, {which} AS which FROM seen WHERE {side}) WHERE which IS NOT NULL"
        )
    union = "\n      UNION ALL ".join(selects)
    return f"""seen AS MATERIALIZED (SELECT n.key, n.t, x.side, regexp_replace(regexp_replace(n.t, '[{word_class()}]', '_', 'g'), '[^\\P{{Nd}}0-9]', '0', 'g') AS u
      FROM norm n JOIN {sides} x USING (key) WHERE n.t <> ''),
    found AS MATERIALIZED ({union}),
    hits AS (SELECT key, ord, signature_id, substring(t, pre + 1, size) AS matched_text, octet_length(encode(left(t, pre))) AS match_offset,
      octet_length(encode(substring(t, pre + 1, size))) AS match_length, score, confidence, severity FROM found)"""
