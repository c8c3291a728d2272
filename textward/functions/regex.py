"""Patterns for the JVM's regular expressions: flags, safe repetition, literal guards; and for RE2."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from typing import NamedTuple

try:
    from re import _parser as sre
except ImportError:  # Python before 3.11
    import sre_parse as sre

#: Case-insensitive, Unicode classes and folding, and only \n ends a line.
FLAGS = "(?iuUd)"
#: A repeated group takes stack for each round in the JVM; more rounds than these are not left to it.
SAFE_ROUNDS = 1000
#: Shorter literals guard little.
LEAST = 3
#: More literals in one test cost more than they save.
MOST = 24
#: So many tests guard a pattern.
TESTS = 3

_TOKEN = re.compile(
    r"\\U[0-9a-fA-F]{8}|\\x\{[0-9a-fA-F]+\}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[pP]\{\w+\}|\\.|\[\^?\]?(?:\\.|\[:\w+:\]|[^\]\\])*\]|\(\?[a-zA-Z]+\)|\(\?(?:[a-zA-Z-]*:|P?<\w+>|<?[=!]|>)|[()|]|(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?|.",
    re.S,
)


def tokens(pattern: str) -> list[str]:
    """A pattern cut into escapes, classes, brackets, repetitions and single characters."""
    return _TOKEN.findall(pattern)


def _repeats(token: str) -> bool:
    return re.fullmatch(r"(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?", token) is not None


def _most(token: str) -> float:
    """The most rounds of a repetition."""
    if token[0] in "*+":
        return float("inf")
    if token[0] == "?":
        return 1
    low, comma, high = token[1 : token.index("}")].partition(",")
    return float(high or ("inf" if comma else low))


def _flags(pattern: str) -> tuple[str, str]:
    """(flags m and s at the start of a pattern, the rest)."""
    lead = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    return ("".join(x for x in lead.group(1) if x in "ms"), pattern[lead.end() :]) if lead else ("", pattern)


def safe_repetition(pattern: str) -> tuple[str, bool]:
    """(pattern, whether the JVM can run it on texts of any length).

    An unbounded repetition of a group is possessive at the end of a top-level alternative: nothing
    follows that could want rounds back, so it matches the same text without the stack.
    Elsewhere it stays as it is, and the pattern counts as unsafe.
    """
    parts, out, depth, safe = tokens(pattern), [], 0, True
    for i, token in enumerate(parts):
        depth += (token[0] == "(" and not re.fullmatch(r"\(\?[a-zA-Z]+\)", token)) - (token == ")")
        if i and parts[i - 1] == ")" and _repeats(token) and _most(token) > SAFE_ROUNDS and token[-1] != "+" or i and parts[i - 1] == ")" and token == "+":
            if depth == 0 and (i + 1 == len(parts) or parts[i + 1] == "|") and token[-1] != "?":
                token += "+"
            else:
                safe = False
        out.append(token)
    return "".join(out), safe


def java_pattern(pattern: str) -> tuple[str, bool]:
    """(pattern with the engine's flags and the JVM's escapes, whether the JVM can run it safely)."""
    extra, body = _flags(pattern)
    body, safe = safe_repetition(body)
    body = "".join("\\x{" + t[2:].lstrip("0") + "}" if t.startswith("\\U") else _wide(t) if t[0] == "[" else t for t in tokens(body))
    return FLAGS[:-1] + extra + ")" + body, safe


def _wide(text: str) -> str:
    return re.sub(r"\\U([0-9a-fA-F]{8})", lambda m: "\\x{" + m.group(1).lstrip("0") + "}", text)


#: In place of a literal: any character beyond ASCII.
BEYOND = "\x80"
_SIGNS = frozenset("@`$<>{}[]|=#/\\" + BEYOND)


def _tells(literal: str) -> bool:
    return len(literal) >= LEAST or not _SIGNS.isdisjoint(literal)


def required(pattern: str) -> list[list[str]]:
    """Tests that every match passes: each is a list of lower-case literals of which the match holds at least one.

    Used as a guard: a text that fails a test needs no regular expression. BEYOND stands for any
    character that is not ASCII. Empty if nothing can be said.
    """
    try:
        parsed = sre.parse(re.sub(r"([+*}])\+", r"\1", pattern.replace("(?U)", "")), re.IGNORECASE)
    except (re.error, OverflowError, ValueError):
        return []
    exact, tests = _needs(parsed)
    if exact is not None:
        _add(tests, exact)
    best = sorted({frozenset(t) for t in tests}, key=lambda t: (-min(map(len, t)) / len(t) ** 0.5, sorted(t)))
    return [sorted(t) for t in best[:TESTS]]


def _add(tests: list[set[str]], literals: set[str]) -> None:
    """One more test, without literals that hold another one; tests that tell little are left out."""
    least = {x for x in literals if not any(y != x and y in x for y in literals)}
    if least and len(least) <= MOST and all(map(_tells, least)):
        tests.append(least)


def _needs(items) -> tuple[set[str] | None, list[set[str]]]:
    """(all strings the items match, or None if there are too many; tests)."""
    run: set[str] = {""}
    whole, tests = True, []

    def close() -> None:
        nonlocal run, whole
        _add(tests, run)
        run, whole = {""}, False

    for op, arg in items:
        name, exact, inner = str(op), None, []
        if name == "LITERAL":
            exact = {chr(arg).lower()} if chr(arg).isascii() else None
            inner = [] if exact else [{BEYOND}]
        elif name == "IN":
            if all(str(o) == "LITERAL" and v < 128 for o, v in arg) and len(arg) <= 6:
                exact = {chr(v).lower() for _, v in arg}
            elif all(str(o) == "LITERAL" and v > 127 or str(o) == "RANGE" and v[0] > 127 for o, v in arg):
                inner = [{BEYOND}]
        elif name == "AT":
            exact = {""}
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            exact, inner = _needs(arg[-1] if name == "SUBPATTERN" else arg)
        elif name == "BRANCH":
            parts = [_needs(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            else:
                chosen = []
                for e, t in parts:
                    options = list(t)
                    if e is not None:
                        # the parser moves a common beginning of the branches before them
                        _add(options, {a + b for a in run for b in e})
                    chosen.append(max(options, key=lambda x: min(map(len, x)) / len(x) ** 0.5, default=None))
                if all(chosen):
                    _add(inner, set().union(*chosen))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            e, t = _needs(arg[2])
            if e is not None and arg[0] == arg[1] == 1:
                exact = e
            elif e is not None and arg[0] == 0 and arg[1] == 1:
                exact = e | {""}
            elif arg[0] > 0:
                inner = t
                if e is not None:
                    _add(inner, e)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
        elif exact is not None:
            close()
            run = set(exact)
        else:
            close()
            tests += inner
    if whole:
        return run, tests
    _add(tests, run)
    return None, tests


@functools.lru_cache(maxsize=1)
def word_ranges() -> tuple[tuple[int, int], ...]:
    """Ranges of the characters beyond ASCII that a Unicode-aware ``\\w`` takes, digits left out."""
    kinds = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nl", "Pc"}
    out: list[list[int]] = []
    for code in range(128, sys.maxunicode + 1):
        if unicodedata.category(chr(code)) in kinds or code in (0x200C, 0x200D):
            if out and out[-1][1] == code - 1:
                out[-1][1] = code
            else:
                out.append([code, code])
    return tuple((a, b) for a, b in out)


def word_class() -> str:
    """The inside of an RE2 class of those characters."""
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in word_ranges())


#: White space beyond ASCII, as the inside of a class.
BLANK = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _beyond(pattern: str) -> bool:
    """Whether a pattern names word characters beyond ASCII."""

    def any_word(text: str) -> bool:
        text = re.sub(r"\\U([0-9a-fA-F]{8})", lambda m: chr(int(m.group(1), 16)), text)
        return any(not c.isascii() and (c.isalnum() or unicodedata.category(c)[0] == "M") for c in text)

    return any(map(any_word, tokens(pattern)))


class Re2(NamedTuple):
    """A pattern for RE2: flags, what may stand before, the match, what may follow; ``plain`` tells the text it is read on."""

    flags: str
    before: str
    core: str
    after: str
    plain: bool

    def test(self) -> str:
        return f"(?i{self.flags}){self.before}(?:{self.core}){self.after}"

    def match(self) -> str:
        """The match is group 1."""
        return f"(?i{self.flags}){self.before}({self.core}){self.after}"

    def head(self) -> str:
        """The text before the first match is group 1."""
        return f"(?i{self.flags})\\A((?s:.*?){self.before})(?:{self.core}){self.after}"


def re2_pattern(pattern: str) -> Re2:
    """A pattern for SQL that has RE2.

    RE2's classes and word boundaries know ASCII only. A pattern of ASCII characters is read on a
    text whose other word characters were replaced one by one by underscores and digits by zeros;
    there its boundaries lie right. Any other pattern is read on the text itself (``plain``), with
    spelled-out classes, and word boundaries at its ends become neighbours.
    """
    extra, body = _flags(pattern)
    parts = tokens(body)
    # an underscore in a class would take replaced characters too
    plain = _beyond(body) or "\\b" not in parts[1:-1] and any(t[0] == "[" and "_" in t for t in parts)
    before = after = ""
    if plain:
        word = f"0-9A-Za-z_\\p{{Nd}}{word_class()}"
        if parts[0] == "\\b":
            before, parts = f"(?:^|[^{word}])", parts[1:]
        if parts and parts[-1] == "\\b":
            after, parts = f"(?:$|[^{word}])", parts[:-1]
        if "\\b" in parts:
            raise ValueError(f"a word boundary inside {pattern!r}")
    return Re2(extra, before, "".join(_re2_token(t, plain) for t in parts), after, plain)


def _re2_token(token: str, plain: bool) -> str:
    inside = {"\\w": f"\\w\\p{{Nd}}{word_class()}" if plain else "\\w", "\\s": f"\\t-\\r {BLANK}", "\\d": "\\d\\p{Nd}"}
    if token in inside:
        return f"[{inside[token]}]"
    if token == "\\S":
        return f"[^{inside['\\s']}]"
    if token.startswith("\\U"):
        return "\\x{" + token[2:].lstrip("0") + "}"
    if token[0] == "[":
        out = _wide(token)
        for name, chars in inside.items():
            out = out.replace(name, chars)
        return out
    if re.fullmatch(r"\\[^\w\s]", token) and not token[1].isascii():
        return token[1]
    return token


def slow_search(pattern: str, text: str) -> tuple[str, int] | None:
    """(match, start) in Python, for a pattern the JVM cannot run on long texts."""
    m = re.search(pattern, text, re.IGNORECASE)
    return (m.group(), m.start()) if m else None

