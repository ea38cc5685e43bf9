"""Reading postal addresses as people write them: unit, floor, street, section, postcode and the words around."""

from __future__ import annotations

import re
from functools import lru_cache

# Words that say what follows, written out. Other ways to write them are not listed anywhere; they are mined.
WAYS = ["JALAN", "LORONG", "PERSIARAN", "LEBUH", "ROAD", "STREET"]
PLACES = ["TAMAN", "BANDAR", "DESA", "MEDAN", "KAMPUNG", "SUNGAI", "PORT"]
UNITS = ["NO", "LOT", "UNIT"]
ORDINALS = {"GROUND": "G", "FIRST": "1", "SECOND": "2", "THIRD": "3", "1ST": "1", "2ND": "2", "3RD": "3"}
#: Words that say nothing of which place.
KINDS = {*WAYS, *PLACES, *UNITS, *ORDINALS, "FLOOR", "TINGKAT", "LEVEL", "LANTAI", "BAWAH", "DASAR", "OFF", "FASA", "MALAYSIA", "ST", "ND", "RD", "F"}

_FLOORS = [
    (re.compile(rf"\(?\b({'|'.join(ORDINALS)})[ .]*FLOOR\b\.?\)?"), lambda m: ORDINALS[m[1]]),
    (re.compile(r"\(?\b([G\d])/F\b\)?"), lambda m: m[1]),
    (re.compile(r"\(?\b(?:TINGKAT|LEVEL|LANTAI)\.? (\d)\b(?!/)\)?"), lambda m: m[1]),
    (re.compile(r"\(?\b(?:TINGKAT BAWAH|LANTAI DASAR)\b\)?"), lambda m: "G"),
]
_MARK = rf"(?:(?:\b(?:{'|'.join(UNITS)})\b|#)[\s.:]*)+"
_NUMBER = r"(?P<n>[0-9OIl]{0,4}\d[0-9OI]{0,3})\s?(?P<l>[A-Z])?(?:\s?-\s?(?P<f>[G\d])(?![\dA-Z]))?(?![\dA-Z/])"
_UNIT = re.compile(_MARK + _NUMBER)
_BARE = re.compile(rf"(?:^|[,;]|\s-\s|\n)\s*{_NUMBER}(?=\s*(?:[,;(]|\s-\s|$))")
_START = re.compile(rf"^\s*{_NUMBER}(?=\s)")
_ANY = re.compile(rf"(?<![\dA-Z/-]){_NUMBER}")
_SECTION = re.compile(r"([A-Z0-9]{2,})\s*[,.]?\s+(\d{1,2}\s?/\s?\d{1,2}[A-Z]?)\b")
_POSTCODE = re.compile(r"(?<![\d/])([0-9OISB]{5}|[0-9O]{3}\s{1,2}[0-9O]{2}|[0-9O]{2}\s{1,2}[0-9O]{3}|[0-9O]{4}\s{1,2}[0-9O]|[0-9O]\s{1,2}[0-9O]{4})(?![\dA-Z/])")
_MARKED = re.compile(_MARK + r"$")
_ROAD = re.compile(rf"\b(?:{'|'.join(WAYS)})\b\.?\s*([A-Z0-9]{{3,}})\s+(\d{{1,3}})\b(?!/)")
_ROAD_ONLY = re.compile(rf"\b(?:{'|'.join(WAYS)})\b\.?\s*([A-Z0-9]{{3,}})")
_NUMBERED_ROAD = re.compile(rf"\b((?:{'|'.join(WAYS)})\.?\s?[A-Z]{{3,}})(\d{{1,2}})(?![\dA-Z/]|\s+\d{{1,2}}/\d)")
_WORD = re.compile(r"[A-Z0-9']+")
_DIGITS = str.maketrans("OISBL", "01581")
_LETTERS = str.maketrans("01234568", "OIZEASGB")


def letters(word: str) -> str:
    return word.translate(_LETTERS) if any(c.isalpha() for c in word) else word


_OPENERS = frozenset(w for w in [*WAYS, *PLACES] if len(w) > 3)


@lru_cache(maxsize=64)
def _stuck(openers: frozenset[str]) -> re.Pattern:
    return re.compile(rf"(?<![A-Z0-9])(?!(?:{'|'.join(_OPENERS)})(?![A-Z0-9]))({'|'.join(sorted(openers, key=lambda x: (-len(x), x)))})\.?(?=[A-Z0-9]{{3,}}(?![A-Z]))")


def openers(rules: dict[str, str]) -> frozenset[str]:
    """Words that may be glued to the name they open: those written out and the mined contractions of them; a mere beginning of
    one may as well begin a name."""
    return _OPENERS | {a for a, b in rules.items() if b in _OPENERS and len(a) > 1 and (len(a) > 2 or not set(a) & set("AEIOU")) and not b.startswith(a)}


def read(address: str | None, rules: dict[str, str] | None = None) -> tuple[str, str, str, str, str, str, list[str], list[str]] | None:
    """(number, letter, floor, road, section, postcode, other words, words that say what follows) of an address, its words
    first rewritten by the rules; None if it has none of these."""
    if not address or not address.strip():
        return None
    u = re.sub(r"[ \t]+", " ", re.sub(r"[\r\n]+", ", ", address.upper())).strip(" .,")
    glued = openers(rules) if rules else _OPENERS
    u = _stuck(glued).sub(lambda m: m[0] + " ", u)
    if rules:
        u = _WORD.sub(lambda m: rules.get(letters(m[0].replace("'", "")), m[0]), u)
    u = re.sub(r"([A-Z]{3,}|[A-Z]+[0-9][A-Z]+)(\d{1,2}/\d{1,2})(?!\d)", r"\1 \2", u)
    u = re.sub(r"(?<=\d)\s?/\s?(?=\d)", "/", u)
    u = _NUMBERED_ROAD.sub(r"\1 \2", u)
    said: list[str] = []

    def out(m: re.Match, keep: str = "") -> str:
        said.extend(w for w in _WORD.findall(m[0]) if w.isalpha() and w != keep)
        return u[: m.start()] + " , " + u[m.end() :]

    floor = ""
    for pattern, level in _FLOORS:
        while m := pattern.search(u):
            floor, u = level(m), out(m)
    road = section = ""
    if m := _SECTION.search(u):
        road, section = letters(m[1]), re.sub(r"\s", "", m[2])
        u = u[: m.start()] + " , " + u[m.end() :]
    elif m := _ROAD.search(u):
        road, section, u = letters(m[1]), m[2], out(m, m[1])
    elif m := _ROAD_ONLY.search(u):
        road, u = letters(m[1]), out(m, m[1])
    post = ""
    hits = [m for m in _POSTCODE.finditer(u) if sum(c.isdigit() for c in m[1]) >= 3 and not _MARKED.search(u[: m.start()])]
    if hits:
        m = hits[-1]
        post, u = re.sub(r"\s", "", m[1]).translate(_DIGITS), u[: m.start()] + " , " + u[m.end() :]
    number = letter = ""
    if m := _UNIT.search(u) or _BARE.search(u) or _START.search(u) or _ANY.search(u):
        number, letter = m["n"].translate(_DIGITS).lstrip("0"), m["l"] or ""
        floor, u = m["f"] or floor, out(m, letter)
    words = []
    for w in _WORD.findall(u):
        w = letters(w.replace("'", ""))
        if w and w.isalpha():
            (said if w in KINDS else words).append(w)
    return (number, letter, floor, road, section, post, words, said) if number or road or post or words else None
