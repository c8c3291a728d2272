"""Texts as lists of named fields: a JSON object or ``name: value`` lines, else prose."""

from __future__ import annotations

import json
import re

_WORDY = re.compile(r"\w")
#: A one-word name and a colon, with or without quotes or emphasis around it.
_NAME = re.compile(r"(?:^|(?<=\s))[^\w\s]{0,4}([A-Za-z][\w.-]{0,40})[^\w\s:]{0,3}[ \t]?:(?=\s)")


def _flat(value) -> str:
    """A JSON value as text; nested values keep their order."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return " ".join(f"{k} {_flat(v)}" for k, v in value.items())
    if isinstance(value, list):
        return " ".join(map(_flat, value))
    return json.dumps(value)


def _split(text: str) -> list[tuple[str, str]]:
    """("", what stands before the first name), (name, what follows it), ..."""
    out, name, at = [], "", 0
    for m in _NAME.finditer(text):
        out.append((name, text[at : m.start()]))
        name, at = m.group(1), m.end()
    out.append((name, text[at:]))
    return out


def parse_fields(text: str) -> list[tuple[str, str]]:
    """(name, value) of a list of named fields, in the order written; prose gives [("", text)].

    A list is a JSON object, or a text that begins with ``name:`` and has two or more such
    one-word names, on lines of their own or not. Marks around the list are left out; names
    inside a JSON value split it as they split a line. Repeated names are kept. Broken JSON is
    prose.
    """
    body = text.strip()
    start, end = body.find("{"), body.rfind("}")
    if 0 <= start < end and not _WORDY.search(body[:start]) and not _WORDY.search(body[end + 1 :]):
        try:
            pairs = json.loads(body[start : end + 1], object_pairs_hook=_Pairs, strict=False)
            if isinstance(pairs, _Pairs) and pairs:
                out = []
                for name, value in pairs:
                    first, *more = _split(_flat(_plain(value)))
                    out += [(str(name), first[1]), *more] if not first[0] else [(str(name), ""), first, *more]
                return out
        except (ValueError, RecursionError):
            pass
    parts = _split(body)
    if len(parts) > 2 and not _WORDY.search(parts[0][1]):
        return parts[1:]
    return [("", body)]


class _Pairs(list):
    """The members of a JSON object in order, repeats kept."""


def _plain(value):
    if isinstance(value, _Pairs):
        return {str(k): _plain(v) for k, v in value}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value
