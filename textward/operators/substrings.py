"""All places of several literals in a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Index of the literal, the text as written, byte offset and byte length.
PLACE = "struct<literal:int,text:string,match_offset:bigint,match_length:bigint>"
_FOLD = {c: c + 32 for c in range(65, 91)}


def places(text: str, literals: list[str], fold: bool) -> list[tuple[int, str, int, int]]:
    """Matches that do not overlap: from left to right, each time the one that ends first, and of these the longest.

    ``fold`` reads ASCII letters without case. Empty literals match nothing.
    """
    plain = text.translate(_FOLD) if fold else text
    found = []
    for i, literal in enumerate(literals):
        body = literal.translate(_FOLD) if fold else literal
        if body:
            # the look-ahead finds overlapping places too
            found += [(m.start() + len(body), m.start(), i) for m in re.finditer(f"(?={re.escape(body)})", plain)]
    out, at = [], 0
    for end, start, i in sorted(found):
        if start >= at:
            out.append((i, text[start:end], len(text[:start].encode()), len(text[start:end].encode())))
            at = end
    return out


def occurrences(text: Column, literals: list[str], fold: bool = True) -> Column:
    """ARRAY<PLACE> of a text, in order; null gives an empty array. Texts without any of the literals stay in the JVM."""

    @F.pandas_udf(f"array<{PLACE}>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("literal", "text", "match_offset", "match_length")
        for part in parts:
            yield pd.Series([[] if t is None else [dict(zip(names, p)) for p in places(t, literals, fold)] for t in part], dtype=object)

    none = F.array().cast(f"array<{PLACE}>")
    wanted = [x for x in literals if x]
    if not wanted:
        return none
    upper = "".join(map(chr, _FOLD))
    plain = F.translate(text, upper, upper.lower()) if fold else text
    hit = F.lit(False)
    for x in wanted:
        hit = hit | F.contains(plain, F.lit(x.translate(_FOLD) if fold else x))
    return F.coalesce(run(F.when(hit, text)), none)
