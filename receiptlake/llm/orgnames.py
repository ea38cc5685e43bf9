"""Reading names of organisations: the proper words, the line of trade, and what is only legal form, branch or noise."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Lines of trade, written out in the languages of the tables; legal forms; words that open the name of a branch. How
# people shorten or misspell the words of a trade is not listed; it is mined.
TRADES = {
    "bakery": ["BAKERY"],
    "cafe": ["CAFE"],
    "clinic": ["KLINIK", "CLINIC"],
    "pharmacy": ["FARMASI", "PHARMACY"],
    "workshop": ["BENGKEL", "WORKSHOP"],
    "restaurant": ["RESTORAN", "RESTAURANT"],
    "toko": ["TOKO"],
    "warung": ["WARUNG"],
    "pasaraya": ["PASARAYA"],
    "clothes": ["PUSAT PAKAIAN", "PAKAIAN"],
    "books": ["KEDAI BUKU", "BUKU"],
    "coffee": ["KEDAI KOPI", "KOPI"],
    "garden": ["GARDEN CENTRE", "GARDEN"],
    "electrical": ["ELECTRICAL"],
    "stationery": ["STATIONERY"],
    "optical": ["OPTICAL"],
    "mini market": ["MINI MARKET", "MINIMARKET"],
    "supermarket": ["SUPERMARKET", "SUPER MARKET"],
    "hardware": ["HARDWARE"],
    "foods": ["FOODS"],
    "sweets": ["SWEETS", "SWEET HOUSE"],
    "textiles": ["TEXTILES"],
    "trading": ["TRADING"],
    "enterprise": ["ENTERPRISE"],
    "chain stores": ["CHAIN STORES"],
}
LEGAL = {"SDN", "BHD", "SENDIRIAN", "BERHAD", "PVT", "LTD", "PRIVATE", "LIMITED", "CO", "COMPANY", "PTE", "INC", "PLT", "LLP", "LLC", "CORP", "TBK", "PT", "CV", "SB"}
BRANCH = re.compile(r"(?:\s[-–—@]\s?|\s?@\s|(?:^|\s)(?:CAW|CAWANGAN|CWGN|BRANCH|OUTLET|BR)\b\.?\s|\s#\s?\d).*$")
_LETTERS = str.maketrans("01234568", "OIZEASGB")

_FORMS = {tuple(w.split()): t for t, names in TRADES.items() for w in names}
#: First words of two-word trades by their first letter and the second word, for names that only have the letter.
_SECOND = {(n[0], n.split()[1]): n.split()[0] for names in TRADES.values() for n in names if " " in n}
_WORDS = {w: (w,) for t, names in TRADES.items() for n in names for w in n.split()}


#: Words that readers know written out.
KNOWN = {*_WORDS, *LEGAL}


def _less_one(w: str) -> set[str]:
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def damerau(a: str, b: str, most: int) -> int:
    """Edits, with swaps of neighbours as one, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


_LONG = [w for w in _WORDS if len(w) >= 5]
_NEAR: dict[str, set[str]] = {}
for _w in [*_LONG, *(x for x in LEGAL if len(x) >= 3)]:
    for _x in {_w, *_less_one(_w)}:
        _NEAR.setdefault(_x, set()).add(_w)


@lru_cache(maxsize=1 << 16)
def lexical(word: str) -> str | None:
    """The word of a trade or legal form that this one is or is a misspelling of."""
    if word in _WORDS or word in LEGAL:
        return word
    for one in (word[:-3] + "Y" if word.endswith("IES") else "", word[:-1] if word.endswith("S") else ""):
        if one in _WORDS:
            return one
    if len(word) >= 4:
        found = set().union(*(_NEAR.get(x, ()) for x in {word, *_less_one(word)}))
        close = sorted(w for w in found if (len(w) >= 5 or len(word) <= 4) and damerau(word, w, 1) <= 1)
        if close and (len(close[0]) >= 5 or close[0] not in _WORDS):
            return close[0] if len(close[0]) >= 6 or close[0] in LEGAL else None
    return None


def cleaned(name: str) -> str:
    """A name in plain capitals, without brackets, branches, numbers and marks within words; letters put for digits that stand for them."""
    u = "".join(c for c in unicodedata.normalize("NFKD", name.upper()) if not unicodedata.combining(c))
    u = re.sub(r"\([^)]*(?:\)|$)|\[[^\]]*\]|[\"“”`*]", " ", u).strip(" .,;:'")
    u = BRANCH.sub("", u)
    u = re.sub(r"#\s?\d+|\b\d+\b", " ", u)
    u = re.sub(r"[A-Z0-9]*[A-Z][A-Z0-9]*", lambda m: m[0].translate(_LETTERS) if not m[0].isalpha() else m[0], u)
    u = re.sub(r"^M/S\b\.?", " ", u)
    u = re.sub(r"'S\b", "", u)
    u = re.sub(r"\bS/B\b", "SB", u)
    u = re.sub(r"\b([A-Z])/(?=[A-Z])", r"\1", u).replace("'", "")
    return re.sub(r"\bP\.?\s+(?=LTD|LIMITED)", " ", u)


_PIECES = re.compile(r"[A-Z]+")


def tokens(name: str) -> list[str]:
    """The different words of a name, for mining."""
    return sorted({*_PIECES.findall(cleaned(name))})


def parse(name: str, rules: dict[str, str] | None = None) -> tuple[str, list[str], bool]:
    """(line of trade or '', proper words in order, whether hyphens or other doubts join some of them); words are rewritten by the
    rules first."""
    u = cleaned(name)
    if rules:
        u = _PIECES.sub(lambda m: rules.get(m[0], m[0]), u)
    words = []
    for part in re.split(r"[\s,.&+/;:|]+", u):
        pieces = [p for p in re.split(r"[-–_]+", part) if p]
        for i, p in enumerate(pieces):
            if p.isalpha() and p not in ("AND", "DAN") or p == "DAN" and len(words) == 0:
                words.append((p, i > 0))
    words = [(w, j) for i, (w, j) in enumerate(words) if not (w == "N" and 0 < i < len(words) - 1 and min(len(words[i - 1][0]), len(words[i + 1][0])) > 2)]  # "A N B"
    trade, proper, doubt, i = "", [], False, 0
    exact = any((w,) in _FORMS for w, _ in words) or any((a[0], b[0]) in _FORMS for a, b in zip(words, words[1:]))
    words = [(_SECOND.get((w, words[i + 1][0]), w) if len(w) == 1 and i + 1 < len(words) else w, j) for i, (w, j) in enumerate(words)]
    lex = [lexical(w) if not exact or lexical(w) in LEGAL else w if w in _WORDS else None for w, _ in words]  # a slip in a trade only counts where none is written right
    while i < len(words):
        w, joined = words[i]
        two = (lex[i] or w, lex[i + 1] or words[i + 1][0]) if i + 1 < len(words) else None
        if two in _FORMS:
            trade, i = trade or _FORMS[two], i + 2
            continue
        if lex[i] in LEGAL and (len(words) > 1):
            i += 1
            continue
        if (lex[i],) in _FORMS and (not trade or w != lex[i] or len(w) > 3):
            trade, i = trade or _FORMS[lex[i],], i + 1
            continue
        if lex[i] and lex[i] in ("PUSAT", "KEDAI", "CENTRE", "MARKET", "MINI", "SUPER", "CHAIN", "STORES") and len(words) > 2:
            i += 1
            continue
        proper.append(w)
        doubt |= joined
        i += 1
    return trade, proper, doubt


def segmentations(words: list[str], doubt: bool) -> list[list[str]]:
    """The proper words as they stand, and, where something looks glued together or torn apart, in other ways."""
    out = [words]
    n = len(words)
    if n > 2 or doubt or n == 2 and min(map(len, words)) < 4:
        out += [words[:i] + [words[i] + words[i + 1]] + words[i + 2 :] for i in range(n - 1)]
        if n > 3:
            out += [["".join(words[:k]), "".join(words[k:])] for k in range(1, n)]
    for i, w in enumerate(words):
        if len(w) >= 9 and n == 1:
            out += [words[:i] + [w[:k], w[k:]] + words[i + 1 :] for k in range(4, len(w) - 3)]
        elif len(w) >= 7 and n == 1:
            out += [words[:i] + [w[:1], w[1:]]]
    return out


def compatible(short: str, full: str) -> bool:
    """Whether one word may stand for the other: initial, beginning, pet form or slip."""
    if short == full:
        return True
    if len(short) > len(full):
        short, full = full, short
    if not short:
        return False
    if len(short) <= 4 and full.startswith(short):
        return True
    if len(short) >= 3 and short[-1] in "YI" and len(full) >= len(short) - 1:
        stem = short[:-1]
        if full.startswith(stem) or len(stem) >= 3 and full.endswith(stem):
            return True
    if len(short) == 3 and len(full) == 4:
        return short[0] == full[0] and damerau(short, full, 1) <= 1
    return len(short) >= 4 and damerau(short, full, 1 if len(full) < 8 else 2) <= (1 if len(full) < 8 else 2)


def likeness(a: str, b: str) -> float:
    """How far one word may stand for the other: 1 for the same, less by every edit, 0.75 for initials, beginnings and pet forms, 0 for others."""
    if a == b:
        return 1.0
    longer = max(len(a), len(b))
    edits = damerau(a, b, 2) if min(len(a), len(b)) >= 4 else 3
    if edits <= 2:
        return 1.0 - edits / longer
    return 0.75 if compatible(a, b) else 0.0
