"""Candidate spans of personal information and the votes of labelers on them.

Texts are read in their consistent form. Every candidate has a type, a place and a key: the
votes of the type's labelers (1 for, -1 against, 0 no opinion) and a few plain features. There are few
different keys, whatever the number of candidates.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

TYPES = ("email", "phone", "national_id", "street_address", "person_name")

# Words that stand before or after personal information, in five languages.
PHONE_WORDS = r"phone|fax|tel|telefon|téléphone|teléfono|телефон|mobile|mobil|cell|handy|call|ring|dial|text|number is|nummer|rufen|appelez|llám\w*|marque|звоните|номеру|номер телефона|whatsapp|sms"
ID_WORDS = r"social security|ssn|insurance|passport|passeport|pasaporte|reisepass|паспорт\w*|tax|steuer\w*|ausweis\w*|personal\w*nummer|id no|id number|identity|identi\w+|national|nif|nie|dni|documento|sécurité sociale|seguridad social|снилс|инн|nino|cpf|svnr|versicherung\w*"
OTHER_NUMBER_WORDS = r"order|invoice|rechnung|version|ticket|case|server|port|build|serial|isbn|issue|vorgang|expediente|dossier|номер дела|update|code|room|chapter|tracking|parcel no|form|error|fehler|row|dock"
NAME_BEFORE = r"my name is|name is|i am called|me llamo|mi nombre es|je m['’ ]appelle|mon nom est|ich heiße|ich heisse|mein name ist|меня зовут|yours truly|yours sincerely|yours faithfully|regards|best wishes|mit freundlichen grüßen|mit freundlichen grüssen|cordialement|saludos|atentamente|с уважением|spoke with|spoken with|talked to|appointment is for|signed by"
NAME_AFTER = r"signed|wrote to|called me|lives at|can be reached|wohnt"
TITLES = r"dr|ms|mr|mrs|miss|prof|herr|frau|mme|mlle|sr|sra|don|doña|г-н|г-жа"
STREETS = r"street|st|road|rd|avenue|ave|lane|ln|drive|dr|terrace|court|ct|way|close|square|sq|row|boulevard|blvd|place|crescent|gardens|hill|park|mews"

_AT = r"(?:@|\s*[(\[{<]\s*(?:at|@|arroba|arobase|собака)\s*[)\]}>]\s*|\s+(?:at|arroba|arobase|собака|klammeraffe)\s+)"
_DOT = r"(?:\.|\s*[(\[{<]\s*(?:dot|punto|point|punkt|точка)\s*[)\]}>]\s*|\s+(?:dot|punto|point|punkt|точка)\s+)"
_EMAIL = re.compile(rf"(?i)(?<![\w.+@-])[\w][\w.+-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)*?{_DOT}[^\W\d_]{{2,}}(?![\w-])(?!{_DOT}[\w-])(?![\w.+-]*@)")
#: The plain spelling of an address, for checks.
PLAIN_EMAIL = re.compile(r"(?<![\w.+@-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@-])")
_NUMBER = re.compile(r"(?i)(?<![\w.+/-])(?:tel:)?(?:\+|\()?\d(?:[\s().\-/]{0,2}\d){6,}(?:[\s-]?[A-Z]\b)?(?![\w])|(?<!\w)[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?!\w)")
_SHAPES = tuple(
    (name, re.compile(pattern, re.I))
    for name, pattern in (
        ("ssn", r"\d{3}[- ]\d{2}[- ]\d{4}"),
        ("cpf", r"\d{3}\.\d{3}\.\d{3}-\d{2}"),
        ("nir", r"\d \d\d \d\d \d\d \d{3} \d{3} \d\d"),
        ("nino", r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]"),
        ("dni", r"\d{8}-?[A-Z]"),
        ("four", r"\d{4} \d{4} \d{4}"),
        ("plus", r"(?:tel:)?\+\d[\d\s().\-/]+|tel:.*"),
        ("zeros", r"00\d[\d\s().\-/]{7,}"),
        ("nanp", r"(?:1[. -])?\(?\d{3}\)?[. -]\d{3}[. -]\d{4}"),
        ("trunk", r"0\d{1,4}[ /.-]?\d[\d\s./-]{4,}"),
        ("ip", r"\d{1,3}(?:\.\d{1,3}){3}"),
        ("date", r"(?:19|20)\d\d-\d\d-\d\d.*|\d{1,2}[./]\d{1,2}[./](?:19|20)\d\d"),
        ("plain", r"\d+"),
    )
)
_ID_SHAPES = {"ssn", "cpf", "nir", "nino", "dni", "four"}
_PHONE_SHAPES = {"plus", "zeros", "nanp", "trunk"}
_NEAR_PHONE = re.compile(rf"(?i)(?<!\w)(?:{PHONE_WORDS})\b[^\n]{{0,18}}$")
_NEAR_ID = re.compile(rf"(?i)(?<!\w)(?:{ID_WORDS})\b[^\n]{{0,22}}$")
_NEAR_OTHER = re.compile(rf"(?i)(?<!\w)(?:{OTHER_NUMBER_WORDS})\b(?: number| no\.?| nr\.?| #)?\s*[:#]?\s*$")
_AFTER_ID = re.compile(rf"(?i)^\W{{0,3}}(?:as|is|ist|es|est)?\s*(?:my |the |mein\w* |mi |mon )?(?:\w+ )?(?:{ID_WORDS})\b")
_ADDRESS = re.compile(
    r"(?i)(?<![\w.])(?:"
    rf"(?:(?:flat|apt|unit|suite)\.?\s\d+\w?,\s*)?\d{{1,4}}[a-z]?\s+(?:[^\W\d_][\w'’-]*\s+){{1,3}}(?:{STREETS})\b\.?"
    r"|\d{1,4}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|impasse|allée|allee|boulevard|place|quai|chemin|route|cours)\s+(?:[^\W\d_][\w'’-]*[ ]?){1,5}"
    r"|[^\W\d_]+(?:straße|strasse|str\.?|weg|gasse|platz|allee|ufer|damm)\s+\d{1,4}\s?[a-z]?\b"
    r"|(?:calle|c/|plaza|avda\.?|avenida|paseo|camino|ronda)\s+(?:[^\W\d_]+\s+){1,5}(?:n[º°.]\s*)?\d{1,4}\b"
    r"|(?:ул\.|улица|пр\.|проспект|пер\.|переулок)\s*[^\W\d_]+,?\s*(?:д\.|дом)?\s*\d{1,4}"
    r"|(?:p\.?\s?o\.?\s?box|post office box|postfach|apartado(?: de correos)?|boîte postale|а/я)\s*(?:no\.?\s*)?\d{1,6}"
    r")(?:,?\s*(?:apt|flat|кв)\.?\s*\d+\w?)?(?:,\s*[^\W\d_]+(?:\s\d{4,6})?|,\s*\d{4,6}\s+[^\W\d_]+)?"
)
_LIVE = re.compile(r"(?i)(?:live at|ship it to|went to|address|deliver\w* to|habite|wohne|vivo en|адрес|живу|send it to|contact:[^\n]{0,30})\W*(?:in der |in |au |en )?$")
_POSTAL = re.compile(r"\b\d{4,6}\b|(?i:apt|flat|box)")
_NOT_STREET = re.compile(r"(?i)\b(?:the|a|an|of|with|and|my|this|for|to|in|units|rows|ideas|items|holes|no|than|by)\b")
_LONG = re.compile(r"\d[\d\s().\-/]{5}")
_DIGIT = re.compile(r"\d")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TITLE = re.compile(rf"(?i)(?<!\w)(?:{TITLES})\.?\s+$")
_BEFORE = re.compile(rf"(?i)(?<!\w)(?:{NAME_BEFORE})\W{{0,4}}(?:(?:{TITLES})\.?\s+){{0,2}}$")
_AFTER = re.compile(rf"(?i)^\W{{0,2}}(?:{NAME_AFTER})\b")
_INTRO = re.compile(rf"(?i)(?<!\w)(?:{NAME_BEFORE})\W{{1,4}}(?:(?:{TITLES})\.?\s+){{0,2}}([^\W\d_][^\W\d_'’-]+)(,?)\s(?:[^\W\d_]\.\s)?([^\W\d_][^\W\d_'’-]+)")
_CARD = re.compile(r"(?i)^\W{0,3}[^\W\d_]+\W{1,3}[^\W\d_]+[^@]{0,60}(?:@|\(at\)|\[at\]|\bat\b|\d{3,})")
_LINK = re.compile(r"^\s+(?:[^\W\d_]\.\s+)?$")
_COMMA = re.compile(r"^,\s+$")


# Cheap tests on a lower-cased text and its words, so that most texts skip the long patterns.
_AT_WORDS = frozenset("arroba arobase собака klammeraffe".split())
#: Never narrower than the address pattern, for the one spelling that is a common word.
_AT_GATE = re.compile(r"[\s(\[{<]at[\s)\]}>]\s*[\w-]+(?:\.[^\W\d_]|\s*[(\[{<]|\s+(?:dot|punto|point|punkt|точка)\s|\.[\w-])")
_STREET_WORDS = frozenset(STREETS.split("|")) | frozenset("rue avenue impasse allée allee boulevard place quai chemin route cours calle c plaza avda avenida paseo camino ronda ул улица пр проспект пер переулок box pobox postfach apartado boîte а".split())
_STREET_ENDS = ("straße", "strasse", "str.", "str ", "weg", "gasse", "platz", "allee", "ufer", "damm")
_INTRO_PARTS = ("name", "llamo", "nombre", "appelle", "nom est", "heiße", "heisse", "зовут", "yours", "regards", "wishes", "grüßen", "grüssen", "cordialement", "saludos", "atentamente", "уважением", "spoke", "talked", "appointment", "signed", "wrote to", "called me", "lives at", "can be reached", "wohnt", "i am called")


class Span(NamedTuple):
    """A candidate: type, place in the consistent form, votes and features."""

    kind: str
    start: int
    end: int
    key: str


def _key(votes: tuple[int, ...], *features: int) -> str:
    return " ".join(map(str, votes)) + "|" + " ".join(map(str, features))


def introduced_names(text: str) -> list[tuple[str, str]]:
    """(given, family), case folded, of names that a phrase introduces or an address repeats.

    The seed of the gazetteer; a name spelled in the e-mail address that follows it counts twice.
    """
    out = []
    low = text.lower()
    if any(x in low for x in _INTRO_PARTS):
        for m in _INTRO.finditer(text):
            first, comma, second = m.groups()
            if first[:1].isupper() and second[:1].isupper():
                out.append((second, first) if comma else (first, second))
    if "@" in low or "(at)" in low or "[at]" in low:
        for m in _LOCAL.finditer(low):
            local = m.group(1)
            pairs = list(_PAIR.finditer(text, max(0, m.start() - 140), m.start()))
            for first, second in (x.groups() for x in pairs):
                if first[:1].isupper() and second[:1].isupper() and plain(first) in local.split(".") + re.split(r"[._+-]", local.rstrip("0123456789")) and len(first) > 2:
                    out += [(first, second)] * 2
    return [(a.casefold(), b.casefold()) for a, b in out]


def plain(word: str) -> str:
    """Lower case letters without accents."""
    return "".join(_PLAIN.get(ch, ch) for ch in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(ch))


# Letters that take no accent off.
_PLAIN = {"ł": "l", "ø": "o", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe"}
_LOCAL = re.compile(r"([\w][\w.+-]*)\s?(?:@|\(at\)|\[at\])")
_PAIR = re.compile(r"(?=(?<![^\W\d_])([^\W\d_]{3,})[ ](?:[^\W\d_]\.[ ])?([^\W\d_]{3,}))")


def _emails(text: str):
    for m in _EMAIL.finditer(text):
        plain = "@" in m.group()
        top = re.split(r"[\s.\])}>]", m.group())[-1]
        votes = (1 if plain else 0, 1 if 2 <= len(top) <= 9 and top.isalpha() else -1, 1 if re.search(r"(?i)(?:mail|почта|reach|forward|login|erreichen|écrivez|escriba|correo|contact|phone)[^@]{0,40}$", text[max(0, m.start() - 60) : m.start()]) else 0, 1 if re.search(r"[._+-]|\d", re.split(_AT, m.group())[0]) else 0)
        yield Span("email", m.start(), m.end(), _key(votes, min(3, m.group().count(" "))))


def _numbers(text: str):
    for m in _NUMBER.finditer(text):
        body = m.group()
        shape = next((name for name, p in _SHAPES if p.fullmatch(body)), "other")
        before, after = text[max(0, m.start() - 48) : m.start()], text[m.end() : m.end() + 48]
        phone, ident, other = bool(_NEAR_PHONE.search(before)), bool(_NEAR_ID.search(before) or _AFTER_ID.search(after)), bool(_NEAR_OTHER.search(before))
        digits = sum(c.isdigit() for c in body)
        # a bare number between the lines of a name card
        card = bool(re.search(r"[;|,\n]\s*$", before) and re.match(r"\s*[;|,\n]", after))
        shaped = (1 if shape in _PHONE_SHAPES else -1 if shape in _ID_SHAPES or shape in ("ip", "date") else 0, 1 if shape in _ID_SHAPES else -1)
        yield Span("phone", m.start(), m.end(), _key((shaped[0], 1 if phone else 0, -1 if ident else 0, -1 if other else 0, 1 if card else 0), min(4, max(0, digits - 7)), int(shape == "plain")))
        yield Span("national_id", m.start(), m.end(), _key((shaped[1], 1 if ident else 0, -1 if phone and not ident else 0, -1 if other else 0), min(4, max(0, digits - 7)), int(shape == "plain"), int(shape in ("four", "dni"))))


def _addresses(text: str):
    cased = None if text.islower() or text.isupper() else True
    for m in _ADDRESS.finditer(text):
        body = m.group()
        head = _ADDRESS_NAME.sub("", body)
        box = bool(re.match(r"(?i)p\.?\s?o|post|apartado|boîte|а/я", body))
        votes = (1 if box else 0, 1 if _LIVE.search(text[max(0, m.start() - 50) : m.start()]) else 0, 1 if _POSTAL.search(body[4:]) else 0, -1 if _NOT_STREET.search(head) and not re.search(r"(?i)rue|avenue|impasse|calle|plaza|avda", body) else 1, 1 if cased is None or any(w[:1].isupper() for w in _WORDS.findall(body)) else -1)
        yield Span("street_address", m.start(), m.end(), _key(votes, int("," in body)))


_ADDRESS_NAME = re.compile(r"^\W*\d+\w?\s|,.*$")


def _names(text: str, intro: bool, given: dict[str, int], family: dict[str, int], common: frozenset[str]):
    words = [(m.start(), m.end(), m.group()) for m in _WORDS.finditer(text)]
    folded = [w[2].casefold() for w in words]
    spots = {i for i, w in enumerate(folded) if w in given}
    if intro:
        for m in _INTRO.finditer(text):
            at = m.start(1)
            spots.update(i for i, w in enumerate(words) if w[0] == at)
    taken = -1
    for i in sorted(spots):
        nexts = i + 2 if i + 2 < len(words) and len(words[i + 1][2]) == 1 else i + 1
        for a, b in ((i - 1, i), (i, nexts)):
            if a <= taken or a < 0 or b >= len(words):
                continue
            gap = text[words[a][1] : words[b][0]]
            comma = bool(_COMMA.match(gap))
            if comma and folded[a] in common:
                continue
            if not comma and (b == i or not _LINK.match(gap)):
                continue
            g, f = (folded[b], folded[a]) if comma else (folded[a], folded[b])
            first, last = words[a][2], words[b][2]
            before, after = text[max(0, words[a][0] - 60) : words[a][0]], text[words[b][1] : words[b][1] + 90]
            told = bool(_BEFORE.search(before) or _AFTER.search(after))
            shape = 1 if first[:1].isupper() and last[:1].isupper() else -1 if first[:1].islower() and last[:1].isupper() else 0
            votes = (
                1 if g in given else 0,
                1 if f in family else -1 if f in common else 0,
                1 if told else 0,
                1 if _TITLE.search(before) else 0,
                1 if _CARD.match(after) else 0,
                shape if not (first.isupper() or text.islower()) else 0,
                -1 if g in common or f in given else 0,
            )
            yield Span("person_name", words[a][0], words[b][1], _key(votes, int(comma), int(len(f) > 3)))
            taken = b
            break


def name_words(text: str) -> set[str]:
    """The words of a text that :func:`spans` looks up among the names: lower-cased ones to begin with, case-folded ones after."""
    words = _WORDS.findall(text)
    return {w.casefold() for w in words} | set(_WORDS.findall(text.lower()))


def spans(text: str, given: dict[str, int], family: dict[str, int], common: frozenset[str]) -> list[Span]:
    """All candidates of a text in consistent form, in order of type."""
    low = text.lower()
    words = set(_WORDS.findall(low))
    out: list[Span] = []
    if "@" in low or not words.isdisjoint(_AT_WORDS) or "at" in words and _AT_GATE.search(low):
        out += _emails(text)
    if _LONG.search(low):
        out += _numbers(text)
    if _DIGIT.search(low):
        if not words.isdisjoint(_STREET_WORDS) or any(x in low for x in _STREET_ENDS):
            out += _addresses(text)
    intro = any(x in low for x in _INTRO_PARTS)
    if intro or not given.keys().isdisjoint(words):
        out += _names(text, intro, given, family, common)
    return out
