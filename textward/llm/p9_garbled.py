"""Problem 9: text that was decoded with the wrong character encoding, found and restored.

A hidden Markov model labels characters: one clean state, one state for each pair (true
encoding, encoding it was read in), and one for characters that are lost. The clean model is a
character-class bigram with character frequencies, counted over all documents. In a pair state
the characters of a passage are taken back to bytes and read in the true encoding, and emit what
the clean model gives to the result; where that is impossible the state emits next to nothing.
Viterbi picks the labels; each labelled span gets its state's inverse transform, and the result
is labelled again, since text can be garbled more than once.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.sources.tables import spread, table

#: (true encoding, encoding it was read in); undefined bytes of the latter read as controls.
PAIRS = (
    ("utf-8", "cp1252"),
    ("utf-8 twice", "cp1252"),
    ("utf-8", "cp1250"),
    ("utf-8", "cp1251"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "cp866"),
    ("utf-8", "mac_roman"),
    ("utf-8", "koi8_r"),
    ("euc_jp", "cp1252"),
    ("cp932", "cp1252"),
    ("gbk", "cp1252"),
    ("euc_kr", "cp1252"),
    ("cp932", "mac_roman"),
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1252"),
    ("cp866", "cp1252"),
    ("koi8_r", "cp1251"),
    ("cp866", "cp1251"),
    ("cp1251", "koi8_r"),
    ("cp1251", "cp866"),
    ("cp1250", "cp1252"),
    ("cp1252", "cp1251"),
    ("cp1252", "cp437"),
    ("cp1252", "mac_roman"),
)
LOST = len(PAIRS) + 1
#: Log-probability of leaving a state, of a character a state can't emit, and of entering a state:
#: reading UTF-8 in another encoding is the usual accident, others need more evidence.
LEAVE, NEVER = -2.5, -25.0
ENTER = [-2.0] + [-2.0 if true == "utf-8" else -3.0 if true == "utf-8 twice" else -8.0 if true in ("euc_jp", "cp932", "gbk", "euc_kr") else -9.0 for true, _ in PAIRS] + [-3.0]

#: A stretch that garbling can have made: it starts and goes on with characters beyond ASCII;
#: single letters and signs between may be second bytes.
_RUN = re.compile("[^\x00-\x7f]+(?:[\x40-\x7e][^\x00-\x7f]+)*(?:[\x40-\x7e](?![a-z]))?")

CLASSES = ("low", "upp", "digit", "space", "sign", "xlow", "xupp", "clow", "cupp", "olow", "oupp", "glow", "gupp", "han", "kana", "hangul", "wide", "symbol", "typo", "box", "control", "mark", "emoji", "lost", "other", "half")


@functools.lru_cache(maxsize=100_000)
def class_of(ch: str) -> str:
    """Class of a character: script and case, or kind of sign."""
    o = ord(ch)
    if o < 128:
        return "low" if ch.islower() else "upp" if ch.isupper() else "digit" if ch.isdigit() else "space" if ch.isspace() else "sign"
    if o == 0xFFFD:
        return "lost"
    if o < 0xA0:
        return "control"
    if 0xC0 <= o < 0x250 and ch.isalpha():
        return "xupp" if ch.isupper() else "xlow"
    if o < 0x100:
        return "symbol"
    if 0x410 <= o <= 0x44F or o in (0x401, 0x451):
        return "cupp" if ch.isupper() else "clow"
    if 0x400 <= o < 0x530:
        return "oupp" if ch.isupper() else "olow"
    if 0x370 <= o < 0x400:
        return "gupp" if ch.isupper() else "glow"
    if 0x2010 <= o < 0x2040 or o in (0x20AC, 0x2122):
        return "typo"
    if 0x2500 <= o < 0x25A0:
        return "box"
    if 0x3040 <= o < 0x3100:
        return "kana"
    if 0x3000 <= o < 0x3040:
        return "wide"
    if 0xFF61 <= o < 0xFFA0:
        return "half"
    if 0xFF00 <= o < 0xFFF0:
        return "wide"
    if 0x4E00 <= o < 0xA000:
        return "han"
    if 0xAC00 <= o < 0xD7A4:
        return "hangul"
    if unicodedata.combining(ch):
        return "mark"
    return "emoji" if o >= 0x1F000 else "other"


@functools.lru_cache(maxsize=None)
def to_byte(codec: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; undefined bytes are control characters."""
    out = {}
    for b in range(128, 256):
        out[bytes([b]).decode("latin-1")] = b
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return out


@functools.lru_cache(maxsize=500_000)
def read_char(true: str, codec: str, text: str) -> tuple[str, int]:
    """The first character of ``text`` read again in the true encoding, and its length here; ("", 0) if none."""
    table_ = to_byte(codec)
    if true == "utf-8 twice":
        inner, used = "", 0
        while len(inner) < 4:
            ch, size = read_char("utf-8", codec, text[used : used + 4])
            if not size:
                break
            inner, used = inner + ch, used + size
            new, size = read_char("utf-8", codec, inner)
            if size == len(inner) > 1:
                return new, used
        return "", 0
    got = bytearray()
    for ch in text[: 4 if true == "utf-8" else 3 if true == "euc_jp" else 2]:
        b = table_.get(ch)
        if b is None:
            if not got or ch >= "\x80":
                break
            b = ord(ch)
        got.append(b)
        try:
            new = got.decode(true)
        except UnicodeDecodeError:
            continue
        # marks, private, unassigned and control characters come from accidents, not from texts
        if len(new) == 1 and unicodedata.category(new) not in ("Mn", "Me", "Co", "Cn") and (ord(new) >= 0xA0 or true == "utf-8"):
            return new, len(got)
        break
    return "", 0


class Model:
    """Clean character model and Viterbi labelling, with caches for the few runs that recur."""

    def __init__(self, bigrams: dict[tuple[str, str], int], chars: dict[str, int]) -> None:
        index = {c: i for i, c in enumerate(CLASSES)}
        totals = Counter()
        for (a, _), n in bigrams.items():
            totals[a] += n
        width = len(CLASSES)
        self.step = {(a, b): math.log((bigrams.get((a, b), 0) + 0.2) / (totals[a] + 0.2 * width)) for a in index for b in index}
        of_class = Counter()
        for ch, n in chars.items():
            of_class[class_of(ch)] += n
        self.unseen = {c: math.log(0.3 / (of_class[c] + 300)) for c in CLASSES}
        self.freq = {ch: math.log((n + 0.3) / (of_class[class_of(ch)] + 300)) for ch, n in chars.items()}
        self.run = functools.lru_cache(maxsize=200_000)(self._run)

    def emit(self, before: str, ch: str) -> float:
        """Log-probability of a character of clean text after a class."""
        kind = class_of(ch)
        return self.step[before, kind] + (self.freq.get(ch, self.unseen[kind]) if ch >= "\x80" else 0.0)

    def _run(self, before: str, run: str) -> tuple[bool, list[list[float]]]:
        """Emissions of a run by state and position; whether some state may beat the clean one."""
        clean, at = [], before
        for ch in run:
            clean.append(self.emit(at, ch))
            at = class_of(ch)
        rows, hopeful = [clean], False
        for true, codec in PAIRS:
            row, at, i, real = [], before, 0, False
            while i < len(run):
                ch = run[i]
                if ch < "\x80":
                    row.append(self.emit(at, ch))
                    at = class_of(ch)
                    i += 1
                    continue
                new, size = read_char(true, codec, run[i : i + 4])
                if not size or new == ch:
                    row.append(NEVER)
                    at = class_of(ch)
                    i += 1
                    continue
                row += [self.emit(at, new) / size] * size
                at, real = class_of(new), True
                i += size
            rows.append(row)
            if real and any(x > y + 1e-9 for x, y in zip(row, clean)):
                hopeful = True
        lost = [0.0 if ch == "�" else NEVER for ch in run]
        rows.append(lost)
        return hopeful or "�" in run, rows

    def labels(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, state) of the spans not labelled clean, in order."""
        runs, hopeful = [], False
        for m in _RUN.finditer(text):
            before = class_of(text[m.start() - 1]) if m.start() else "space"
            maybe, rows = self.run(before, m.group())
            hopeful |= maybe
            runs.append((m.start(), maybe, rows))
        if not hopeful:
            return []
        states = LOST + 1
        best = [0.0] + ENTER[1:]
        back: list[list[int]] = []
        places: list[int] = []
        for start, maybe, rows in runs:
            # a run that only the clean state explains is one observation
            columns = zip(*rows) if maybe else [[sum(row) for row in rows]]
            for k, column in enumerate(columns):
                # every change leads through the clean state or ends in it
                top = max(range(states), key=best.__getitem__)
                floor = best[top] + (LEAVE if top else 0.0)
                choice = [s if best[s] >= floor + (ENTER[s] if s else 0.0) else top for s in range(states)]
                best = [(best[s] if choice[s] == s else floor + (ENTER[s] if s else 0.0)) + column[s] for s in range(states)]
                back.append(choice)
                places.append(start + k if maybe else -1)
        state = max(range(states), key=best.__getitem__)
        path = []
        for choice in reversed(back):
            path.append(state)
            state = choice[state]
        spans: list[list[int]] = []
        for place, state in zip(places, reversed(path)):
            if state == 0 or place < 0:
                continue
            if spans and spans[-1][2] == state and spans[-1][1] == place:
                spans[-1][1] = place + 1
            else:
                spans.append([place, place + 1, state])
        for k, span in enumerate(spans):
            # a word is not garbled by halves: a span takes in the unlabelled rest of its run
            low = spans[k - 1][1] if k else 0
            high = spans[k + 1][0] if k + 1 < len(spans) else len(text)
            while span[0] > low and self._extends(text[span[0] - 1], span[2]):
                span[0] -= 1
            while span[1] < high and self._extends(text[span[1]], span[2]):
                span[1] += 1
        return [tuple(s) for s in spans]

    @staticmethod
    def _extends(ch: str, state: int) -> bool:
        """Whether a character beyond ASCII reads as one character in a state of two single-byte encodings."""
        if ch < "\x80" or state == LOST or PAIRS[state - 1][0] in ("utf-8", "utf-8 twice", "euc_jp", "cp932", "gbk", "euc_kr"):
            return False
        return read_char(*PAIRS[state - 1], ch)[1] == 1

    def restore(self, text: str) -> tuple[str, list[int]]:
        """The text with every garbled span put right where that is possible, and the states found."""
        found: list[int] = []
        while True:
            spans = self.labels(text)
            if not spans:
                break
            out, at, changed = [], 0, False
            for start, end, state in spans:
                found.append(state)
                new = inverse(text[start:end], state)
                changed |= new != text[start:end]
                out += (text[at:start], new)
                at = end
            before, text = len(text), "".join(out) + text[at:]
            # only UTF-8 read wrongly is written as UTF-8 and read wrongly again; undoing it makes the text shorter, so the rounds end
            if not changed or len(text) >= before or any(state != LOST and not PAIRS[state - 1][0].startswith("utf-8") for _, _, state in spans):
                break
        return text, found


def inverse(span: str, state: int) -> str:
    """A span read again in the true encoding; characters that can't be stay."""
    if state == LOST:
        return span
    true, codec = PAIRS[state - 1]
    out, i = [], 0
    while i < len(span):
        new, size = read_char(true, codec, span[i : i + 4]) if span[i] >= "\x80" else (span[i], 1)
        out.append(new if size else span[i])
        i += size or 1
    return "".join(out)


#: What a passage may hold that was garbled for sure: letters and the signs of written text.
_WRITTEN = {"xlow", "xupp", "clow", "cupp", "han", "kana", "wide", "hangul", "typo", "symbol"}
_LETTERS = {"xlow", "xupp", "clow", "cupp", "typo"}


def _strict(run: str) -> str:
    """A run with what reads as UTF-8 after one of the first pairs read so, again and again."""
    for true, codec in PAIRS:
        if true == "utf-8":
            bytes_ = to_byte(codec)
            if codec != "cp1252" and not all(ch in bytes_ or ch < "\x80" for ch in run):
                continue
            written = _WRITTEN if codec == "cp1252" else _LETTERS
            out, i = [], 0
            while i < len(run):
                new, size = read_char(true, codec, run[i : i + 4]) if run[i] >= "\x80" else ("", 0)
                good = size > 1 and class_of(new) in written
                out.append(new if good else run[i])
                i += size if good else 1
                if not good and run[i - 1] >= "\x80" and codec != "cp1252":
                    out = [run]
                    break
            new = "".join(out)
            if new != run:
                return _strict(new)
    return run


_CONTEXT = re.compile("(?s).?[^\x00-\x7f]+.?")


def count_characters(df: DataFrame, column: str, before: tuple | None = None) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """Class bigrams and character counts around all characters beyond ASCII of the column.

    Stretches that read as UTF-8 after a wrong decoding count as what they should be; given the
    counts of a pass ``before``, texts are restored by that model first (one step of
    expectation-maximisation with hard labels). Every task
    sends one row per class pair and per character seen: both are
    bounded by Unicode, not by the data, so the sums may come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strict = functools.lru_cache(maxsize=100_000)(_strict)
        pairs, chars = Counter(), Counter()
        model = Model(*before) if before else None
        for batch in batches:
            stretches = Counter()
            for t in batch.column(0).to_pylist():
                if t and not t.isascii():
                    stretches.update(_CONTEXT.findall(model.restore(t)[0] if model else t))
            for s, n in stretches.items():
                if len(s) > 2:
                    s = s[0] + strict(s[1:-1]) + s[-1]
                for a, b in zip(s, s[1:]):
                    pairs[class_of(a), class_of(b)] += n
                for ch in s:
                    if ch >= "\x80":
                        chars[ch] += n
        rows = [(a, b, n) for (a, b), n in pairs.items()] + [(ch, "", n) for ch, n in chars.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["a", "b", "n"])

    got = df.select(column).mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return {(r.a, r.b): r.n for r in got if r.b}, {r.a: r.n for r in got if not r.b}


def restored(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, states (ARRAY<STRING> found), lost (BOOLEAN), text (restored) of the texts with garbled spans.

    Null and empty texts have none. Other columns of ``df`` don't matter.
    """
    bigrams, chars = count_characters(df, text_column, count_characters(df, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(bigrams, chars)
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t or t.isascii():
                    continue
                new, found = model.restore(t)
                if found:
                    names = sorted({"lost" if s == LOST else "/".join(PAIRS[s - 1]) for s in found})
                    out.append((i, names, LOST in found, new))
            types = (pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["id", "states", "lost", "text"])

    return df.select(F.col(id_column).cast("long"), text_column).mapInArrow(run, "id long, states array<string>, lost boolean, text string")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of the documents with a garbled passage, restorable or not."""
    return restored(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text").select(F.col("id").alias("doc_id"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, states, lost, text: the garbled documents, restored where possible."""
    return restored(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text").withColumnRenamed("id", "doc_id")
