"""Normalisation of a text before it is scanned, as Column expressions.

Order: cut to a byte limit, count and strip invisible characters, NFKC (the one step without a
built-in function, an Arrow UDF that passes ASCII through), strip again, map look-alike
letters, undo encodings of the whole text. Null texts count as empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that decide results.
MAX_BYTES = 1_048_576
MAX_DEPTH = 5
MAX_AMPLIFICATION = 10
INVISIBLE = "".join(map(chr, [0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD, 0x034F, 0x061C, 0x180E, *range(0x2060, 0x2065), *range(0xFE00, 0xFE10)]))
BIDI = "".join(map(chr, [*range(0x202A, 0x202F), *range(0x2066, 0x206A)]))
ZERO_WIDTH = "".join(map(chr, [0x200B, 0x200C, 0x200D, 0xFEFF, 0x2060]))
LOOKALIKE_FROM, LOOKALIKE_TO = "аеорсухіѕһ", "aeopcyxish"
ENGLISH_MARKS = ("the", "and", "you", "ignore", "system", "instructions", "prompt")
#: White space of any kind.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ROT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def sql_string(value: str) -> str:
    """A SQL literal of a string; characters beyond printable ASCII are escaped."""
    return "'" + "".join(ch if ch.isascii() and ch.isprintable() and ch not in "'\\" else f"\\u{ord(ch):04x}" if ord(ch) < 0x10000 else f"\\U{ord(ch):08x}" for ch in value) + "'"


@F.pandas_udf(T.StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in part], dtype=object)


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; null stays null. Only texts beyond ASCII leave the JVM."""
    return F.coalesce(_nfkc(F.when(F.octet_length(text) > F.length(text), text)), text)


def truncate(text: Column) -> Column:
    """At most MAX_BYTES bytes of UTF-8; a character cut apart is left out."""
    head = F.substring(F.encode(text, "UTF-8"), 1, MAX_BYTES)
    valid = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "�{1,3}$", "")
    return F.when(F.octet_length(text) > MAX_BYTES, valid).otherwise(text)


def was_truncated(text: Column) -> Column:
    return F.octet_length(text) > MAX_BYTES


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def strip_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def map_lookalikes(text: Column) -> Column:
    """Ten Cyrillic letters, and full-width Latin letters, as plain letters."""
    wide = "".join(chr(o) for o in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
    plain = "".join(chr(o - 0xFEE0) for o in map(ord, wide))
    return F.translate(text, LOOKALIKE_FROM + wide, LOOKALIKE_TO + plain)


def rot13(text: Column) -> Column:
    return F.translate(text, ROT_FROM, ROT_TO)


def looks_english(text: Column) -> Column:
    """Whether a text holds one of the marks, in any case."""
    return text.rlike("(?i)" + "|".join(ENGLISH_MARKS))


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def try_base64(text: Column) -> Column:
    """The text behind canonical, padded base64 (white space inside is ignored), or null."""
    body = trim(text)
    packed = F.translate(body, BLANKS, "")
    raw = F.try_to_binary(packed, F.lit("base64"))
    fits = (F.octet_length(body) >= 4) & body.rlike(r"(?U)^[A-Za-z0-9+/=\s]+$") & (F.length(packed) % 4 == 0)
    same = F.regexp_replace(F.base64(raw), r"\s", "") == packed
    out = raw.cast("string")
    return F.when(fits & same & F.is_valid_utf8(out), out)


def try_hex(text: Column) -> Column:
    """The text behind 8 or more hexadecimal digits, an even number, or null."""
    body = trim(text)
    raw = F.try_to_binary(body, F.lit("hex"))
    out = raw.cast("string")
    return F.when((F.length(body) >= 8) & (F.length(body) % 2 == 0) & body.rlike("^[0-9A-Fa-f]+$") & F.is_valid_utf8(out), out)


def decode(text: Column) -> Column:
    """STRUCT<t, enc ARRAY<STRING>, stop>: up to MAX_DEPTH encodings of the whole text undone.

    At each level base64 is tried before hexadecimal; rot13 comes last and ends the search. A
    result must differ and have at most MAX_AMPLIFICATION times the bytes of the original.
    """
    limit = F.octet_length(text) * MAX_AMPLIFICATION
    kind = "struct<t:string,enc:array<string>,stop:boolean>"
    start = F.struct(text.alias("t"), F.array().cast("array<string>").alias("enc"), F.lit(False).alias("stop")).cast(kind)

    def result(t: Column, enc: Column, stop: bool) -> Column:
        return F.struct(t.alias("t"), enc.alias("enc"), F.lit(stop).alias("stop")).cast(kind)

    def step(state: Column, _level: Column) -> Column:
        # bound once per level, so that no candidate is worked out twice
        tried = F.transform(F.array(state), lambda s: F.struct(s.alias("s"), try_base64(s["t"]).alias("b"), try_hex(s["t"]).alias("h"), rot13(s["t"]).alias("r")))

        def choose(x: Column) -> Column:
            t, enc = x["s"]["t"], x["s"]["enc"]
            ok = lambda y: y.isNotNull() & (F.octet_length(y) <= limit) & (y != t)
            return (
                F.when(ok(x["b"]), result(x["b"], F.array_append(enc, F.lit("base64")), False))
                .when(ok(x["h"]), result(x["h"], F.array_append(enc, F.lit("hex")), False))
                .when(looks_english(x["r"]) & ~looks_english(t), result(x["r"], F.array_append(enc, F.lit("rot13")), True))
                .otherwise(result(t, enc, True))
            )

        return F.when(state["stop"], state).otherwise(F.element_at(F.transform(tried, choose), 1))

    # prose has a character no encoding has, and passes by; the test ends at the first such character
    encoded = text.rlike(r"(?U)\A[A-Za-z0-9+/=\s]*\z") | (~looks_english(text) & looks_english(rot13(text)))
    return F.when(encoded, F.aggregate(F.sequence(F.lit(1), F.lit(MAX_DEPTH)), start, step)).otherwise(result(text, F.array().cast("array<string>"), True))


def normalise(df: DataFrame, text: str = "text", prefix: str = "norm") -> DataFrame:
    """Add ``{prefix}``: STRUCT<processed_text, encodings_found, invisible_chars_removed, homoglyphs_mapped, was_truncated>."""
    a, b, c, d = (f"__{prefix}_{x}" for x in "abcd")
    out = df.withColumn(a, truncate(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn(b, strip_invisible(nfkc(strip_invisible(F.col(a)))))
    out = out.withColumn(c, map_lookalikes(F.col(b)))
    out = out.withColumn(d, decode(F.col(c)))
    return out.withColumn(
        prefix,
        F.struct(
            F.col(d)["t"].alias("processed_text"),
            F.col(d)["enc"].alias("encodings_found"),
            count_of(F.col(a), INVISIBLE).alias("invisible_chars_removed"),
            (F.col(b) != F.col(c)).alias("homoglyphs_mapped"),
            was_truncated(F.coalesce(F.col(text), F.lit(""))).alias("was_truncated"),
        ),
    ).drop(a, b, c, d)


def unicode_analysis(text: Column) -> Column:
    """STRUCT<invisible_chars, homoglyphs_detected, bidi_overrides, zero_width_chars, normalized_text>."""
    norm = strip_invisible(nfkc(text))
    return F.struct(
        count_of(text, INVISIBLE).alias("invisible_chars"),
        ((norm != text) & text.rlike(r"[^\x00-\x7F]")).alias("homoglyphs_detected"),
        count_of(text, BIDI).alias("bidi_overrides"),
        count_of(text, ZERO_WIDTH).alias("zero_width_chars"),
        norm.alias("normalized_text"),
    )


@F.pandas_udf(T.DoubleType())
def _byte_entropy(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import numpy as np

    for part in texts:
        out = []
        for t in part:
            n = np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) if t else np.zeros(1)
            p = n[n > 0] / max(1, n.sum())
            out.append(abs(float(-(p * np.log2(p)).sum())))
        yield pd.Series(out, dtype=float)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a byte of UTF-8; 0 for an empty or null text."""
    return _byte_entropy(text)


def abnormal_entropy(text: Column, low: float, high: float) -> Column:
    """Whether a text of 20 or more bytes has an entropy outside low..high."""
    return (F.octet_length(text) >= 20) & ((entropy(text) < low) | (entropy(text) > high))
