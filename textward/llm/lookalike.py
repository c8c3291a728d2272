"""One consistent form for texts that look the same but are written with other characters.

Look-alike classes are the transitive closure (union-find) of look-alike links over strings
and code points: compatibility letters and digits, spaces, invisible characters, base letters
with combining marks, and letters of other scripts. Each class has one representative per
script, the member that is most frequent in the corpus; a multi-pattern automaton finds the
members, and the longest match at each place is rewritten greedily. In a word that contains
letters found in one script only, that script's representatives are taken (a Cyrillic word
stays Cyrillic); words of look-alike letters alone follow the rest of the text.

Letter case, accents, punctuation and ordinary spacing stay as they are.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that cannot be seen.
INVISIBLE = (
    "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮"
    "⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿︀︁"
    "︂︃︄︅︆︇︈︉︊︋︌︍︎️"
)

# Look-alike letters, each group written as the plain letter and those that look like it.
LOOKALIKE = """
A А Α Ꭺ ꓮ
B В Β Ᏼ ꓐ
C С Ϲ Ꮯ ꓚ
D Ꭰ ꓓ
E Е Ε Ꭼ ꓰ
F Ϝ ꓝ
G Ԍ Ꮐ ꓖ
H Н Η Ꮋ ꓧ
I І Ι Ӏ ꓲ
J Ј Ϳ Ꭻ ꓙ
K К Κ Ꮶ ꓗ
L Ꮮ ꓡ
M М Μ Ϻ Ꮇ ꓟ
N Ν ꓠ
O О Ο Օ ꓳ
P Р Ρ Ꮲ ꓑ
Q Ԛ
R Ꮢ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Т Τ Ꭲ ꓔ
U Ս ꓴ
V Ѵ Ꮩ ꓦ
W Ԝ Ꮃ ꓪ
X Х Χ ꓫ
Y У Υ Ү ꓬ
Z Ζ Ꮓ ꓜ
a а α ɑ
b Ь
c с ϲ
d ԁ ɗ
e е ҽ
f ք
g ɡ ց
h һ հ
i і ι ı
j ј ϳ
k κ
l ӏ ⅼ
n ո
o о ο օ
p р ρ
q ԛ զ
s ѕ
u υ ս
v ν ѵ
w ԝ ѡ
x х χ
y у γ ү
z ᴢ
Ä Ӓ
ä ӓ
Ë Ё
ë ё
Ï Ї
ï ї
"""

_SCRIPTS = (("latin", 0x41, 0x24F), ("ipa", 0x250, 0x2AF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F))
_OTHER = re.compile("[Ͱ-֏]")
#: Members without an ASCII start lie in such runs; the character before may carry a mark.
_RUN = re.compile(r"(?s).?[^\x00-\x7f]+")
_WORD = re.compile(r"[^\W\d_]+")


def script_of(ch: str) -> str:
    """Script of a letter; plain, IPA and rare look-alike letters count as Latin."""
    o = ord(ch)
    for name, low, high in _SCRIPTS:
        if low <= o <= high:
            return "latin" if name == "ipa" else name
    return "latin"


class UnionFind:
    """Disjoint sets of strings; a bounded structure, one node per character or string."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = self.parent.setdefault(x, x)
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(b)] = self.find(a)


def links() -> Iterator[tuple[str, str]]:
    """Look-alike links: (plain string, string that looks the same)."""
    for ch in INVISIBLE:
        yield "", ch
    for line in LOOKALIKE.split("\n"):
        plain, *others = line.split() or [""]
        for other in others:
            yield plain, other
    # Ideographs and Hangul syllables have no look-alikes here; NFC composes the latter.
    for o in itertools.chain(range(0xA0, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0x2F800, 0x2FA20)):
        ch = chr(o)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            yield " ", ch
        elif kind[0] in "LNP" and kind != "No" or 0xFF01 <= o <= 0xFF5E:
            compat = unicodedata.normalize("NFKC", ch)
            if compat != ch and (compat.isalnum() or 0xFF01 <= o <= 0xFF5E):
                yield compat, ch
        if kind[0] == "L":
            parts = unicodedata.normalize("NFD", ch)
            if 2 <= len(parts) <= 3 and unicodedata.normalize("NFC", parts) == ch:
                yield ch, parts


@functools.lru_cache(maxsize=1)
def classes() -> dict[str, list[str]]:
    """Transitive look-alike classes of more than one member, by some member of each."""
    sets, members = UnionFind(), {}
    for a, b in links():
        sets.union(a, b)
    for x in list(sets.parent):
        members.setdefault(sets.find(x), []).append(x)
    return {root: sorted(x, key=lambda s: (len(s), s)) for root, x in members.items() if len(x) > 1}


@functools.lru_cache(maxsize=1)
def _single_members() -> np.ndarray:
    return np.array(sorted({ord(x) for group in classes().values() for x in group if len(x) == 1}), dtype=np.int64)


class Rewriter:
    """Rewrites texts to the consistent form, given how often each class member occurs."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.auto = ahocorasick.Automaton()
        self.by_script: dict[str, dict[str, str]] = {}
        self.shared: set[str] = set()
        for group in classes().values():
            if "" in group:
                plain = ""
            elif " " in group:
                plain = " "
            else:
                # Styled forms never stand for a class; of the others the most frequent one does.
                def rank(x: str) -> tuple:
                    return (unicodedata.normalize("NFKC", x) != x, -counts.get(x, 0), len(x), x)

                plain = min(group, key=rank)
                letters = [x for x in group if len(x) == 1 and unicodedata.normalize("NFKC", x) == x]
                scripts: dict[str, list[str]] = {}
                for x in letters:
                    scripts.setdefault(script_of(x), []).append(x)
                if len(scripts) > 1:
                    best = {name: min(xs, key=rank) for name, xs in scripts.items()}
                    self.shared.update(letters)
                    for x in letters:
                        self.by_script[x] = {**{name: plain for name in ("latin", "greek", "cyrillic", "armenian")}, **best}
            for x in group:
                if x != plain and x and not (len(x) == 1 and x.isascii()):
                    new = self.by_script[x][script_of(x)] if x in self.by_script else plain
                    if x != new:
                        self.auto.add_word(x, (len(x), new))
        self.auto.make_automaton()
        self._word = functools.lru_cache(maxsize=200_000)(self._word_script)
        greedy = functools.lru_cache(maxsize=200_000)(self._greedy)
        self._run = lambda match: greedy(match.group())
        self._letters_of_one_script = functools.lru_cache(maxsize=200_000)(self._own_scripts)

    def _greedy(self, run: str) -> str:
        """The longest class members of a run, from left to right, rewritten."""
        out, at = [], 0
        for end, (size, new) in self.auto.iter_long(run):
            out += (run[at : end - size + 1], new)
            at = end + 1
        return "".join(out) + run[at:] if out else run

    def _own_scripts(self, word: str) -> tuple[int, int, int, int]:
        """Letters that belong to one script only: Latin, Greek, Cyrillic, Armenian."""
        n = {"latin": 0, "greek": 0, "cyrillic": 0, "armenian": 0}
        for ch in word:
            if ch not in self.shared and ch.isalpha():
                n[script_of(ch)] += 1
        return tuple(n.values())

    @staticmethod
    def _most(n) -> str | None:
        best = max(n)
        return ("latin", "greek", "cyrillic", "armenian")[n.index(best)] if best else None

    def _word_script(self, word: str) -> str | None:
        return self._most(list(self._letters_of_one_script(word)))

    def __call__(self, text: str) -> str:
        """The consistent form; ASCII texts are their own form."""
        if text.isascii():
            return text
        text = _RUN.sub(self._run, text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if _OTHER.search(text):
            total = [0, 0, 0, 0]
            for word in _WORD.findall(text):
                for i, n in enumerate(self._letters_of_one_script(word)):
                    total[i] += n
            rest = self._most(total) or "latin"
            table = self.by_script

            def put(match: re.Match) -> str:
                word = match.group()
                # Plain words of some length stay plain, also among words of another script.
                if word.isascii() and (rest == "latin" or len(word) > 2):
                    return word
                script = self._word(word) or rest
                if script == rest != "latin" and len(word) > 2 and any(ch < "\x80" for ch in word) and not self._word(word):
                    script = "latin"
                return "".join([table[ch][script] if ch in table else ch for ch in word])

            text = _WORD.sub(put, text)
        return text


    def aligned(self, text: str):
        """The consistent form, and a function from its places to places of the text.

        A place inside a rewritten run is mapped to a place inside or at the end of the run as
        written; places outside runs are exact.
        """
        form = self(text)
        if len(form) == len(text):
            return form, lambda place: place
        ends: list[tuple[int, int]] = [(0, 0)]
        shift = 0
        for m in _RUN.finditer(text):
            new = len(unicodedata.normalize("NFC", self._run(m)))
            if new != m.end() - m.start():
                shift += new - (m.end() - m.start())
                ends.append((m.end() + shift, m.end()))
        at = [e[0] for e in ends]

        def place(i: int) -> int:
            k = bisect.bisect_right(at, i) - 1
            limit = len(text)
            return min(limit, ends[k][1] + i - ends[k][0])

        return form, place


def member_counts(df: DataFrame, column: str) -> dict[str, int]:
    """How often each class member occurs in the whole column (null texts count nothing).

    Every task counts by itself and sends one row per member seen; the result has at most as
    many rows as there are members (fixed by Unicode), so it may come to the driver.
    """
    wanted = _single_members()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(wanted.max()) + 1, dtype=np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
            codes = codes[codes < len(total)]
            part = np.bincount(codes)
            total[: len(part)] += part
        seen = wanted[total[wanted] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["code", "n"])

    rows = df.select(column).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {chr(r.code): r.n for r in rows}


_REWRITERS: dict[tuple, Rewriter] = {}


def rewriter_of(key: tuple) -> Rewriter:
    """A worker's rewriter for member counts, built once."""
    if key not in _REWRITERS:
        _REWRITERS.clear()
        _REWRITERS[key] = Rewriter(dict(key))
    return _REWRITERS[key]


def counts_key(*counts: dict[str, int]) -> tuple:
    """Summed member counts in a form that can be sent to workers."""
    total: dict[str, int] = {}
    for part in counts:
        for x, n in part.items():
            total[x] = total.get(x, 0) + n
    return tuple(sorted(total.items()))


def consistent_form(key: tuple):
    """A vectorised function STRING -> consistent form (null stays null)."""

    @F.pandas_udf("string")
    def form(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = rewriter_of(key)
        for part in texts:
            yield pd.Series([None if t is None else rewrite(t) for t in part], dtype=object)

    return form
