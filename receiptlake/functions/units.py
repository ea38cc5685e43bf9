"""A grammar for quantities written as text: numbers, units, scales, and what surrounds them.

A unit is a vector of exponents over base dimensions with a scale and an offset to the canonical unit of that vector, so
``km/h`` is ``{length: 1, time: -1}`` with scale 1000/3600 and ``°C`` is ``{temperature: 1}`` with offset 273.15.
Each currency is a base dimension of its own; between currencies only a table of rates converts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache


@dataclass(frozen=True)
class Unit:
    """value in canonical units = number * scale + offset; dims: sorted (base, exponent)."""

    dims: tuple[tuple[str, int], ...]
    scale: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)

    def __mul__(self, other: Unit) -> Unit:
        if self.offset or other.offset:
            raise ValueError("a unit with an offset can't be part of a product")
        exps = dict(self.dims)
        for base, e in other.dims:
            exps[base] = exps.get(base, 0) + e
        return Unit(tuple(sorted((b, e) for b, e in exps.items() if e)), self.scale * other.scale)

    def __pow__(self, n: int) -> Unit:
        if self.offset and n != 1:
            raise ValueError("a unit with an offset can't be raised to a power")
        return self if n == 1 else Unit(tuple((b, e * n) for b, e in self.dims if e * n), self.scale**n)


def _base(dim: str, scale: str | int | Fraction = 1, offset: str | int = 0) -> Unit:
    return Unit(((dim, 1),), Fraction(scale), Fraction(offset))


#: Marks the currency or minor unit that only the source tells.
SOURCE = "?"
HUNDREDTH = Fraction(1, 100)

# Names of currencies and of their hundredths.
MAJOR = {
    "MYR": ["rm", "myr", "ringgit"],
    "IDR": ["rp", "idr", "rupiah"],
    "INR": ["rs", "inr", "₹", "rupee", "rupees"],
    "GBP": ["£", "gbp", "pound", "pounds"],
    "USD": ["us$", "usd", "us dollar", "us dollars"],
    "AUD": ["a$", "au$", "aud", "australian dollar", "australian dollars"],
    "SGD": ["s$", "sgd", "singapore dollar", "singapore dollars"],
    "EUR": ["€", "eur", "euro", "euros"],
    SOURCE: ["$", "dollar", "dollars"],
}
MINOR = {
    "MYR": ["sen"],
    "INR": ["paise", "paisa"],
    "GBP": ["pence", "penny", "p"],
    "USD": ["us cent", "us cents"],
    "AUD": ["aust. cent", "aust. cents", "australian cents"],
    "SGD": ["sing. cent", "sing. cents", "singapore cents"],
    SOURCE: ["c", "¢", "cent", "cents"],
}
SCALES = {
    "k": 1000, "thousand": 1000, "thousands": 1000, "rb": 1000, "ribu": 1000, "ribuan": 1000, "'000": 1000, "x1000": 1000,
    "jt": 10**6, "juta": 10**6, "jutaan": 10**6, "million": 10**6, "millions": 10**6, "mn": 10**6,
    "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "l": 10**5, "crore": 10**7, "cr": 10**7,
}
#: Words that say what the number is and change nothing.
LABELS = ["total", "ttl", "jumlah", "amount", "amt", "due", "only", "in", "dalam", "sub", "grand", "nett", "net"]
MEASURES = {
    "m": _base("length"), "km": _base("length", 1000), "cm": _base("length", "1/100"), "mm": _base("length", "1/1000"),
    "in": _base("length", "127/5000"), "ft": _base("length", "381/1250"), "mi": _base("length", "201168/125"),
    "kg": _base("mass"), "g": _base("mass", "1/1000"), "mg": _base("mass", "1/1000000"), "lb": _base("mass", "45359237/100000000"), "oz": _base("mass", "45359237/1600000000"),
    "s": _base("time"), "min": _base("time", 60), "h": _base("time", 3600), "day": _base("time", 86400),
    "K": _base("temperature"), "°C": _base("temperature", 1, "273.15"), "°F": _base("temperature", "5/9", "45967/180"),
    "l": Unit((("length", 3),), Fraction(1, 1000)), "L": Unit((("length", 3),), Fraction(1, 1000)), "ml": Unit((("length", 3),), Fraction(1, 10**6)),
    "N": Unit((("length", 1), ("mass", 1), ("time", -2))), "J": Unit((("length", 2), ("mass", 1), ("time", -2))), "W": Unit((("length", 2), ("mass", 1), ("time", -3))),
}


def unit_of(text: str) -> Unit | None:
    """``kg``, ``km/h``, ``kg m^2 s^-2``, ``m²/s``; None if a part is unknown or a unit with an offset is in a product."""
    text = text.strip().replace("²", "^2").replace("³", "^3").replace("·", " ").replace("*", " ")
    out, sign, n = Unit(()), 1, 0
    for part in re.findall(r"/|[^\s/]+", text):
        if part == "/":
            sign = -1
            continue
        name, _, e = part.partition("^")
        if name not in MEASURES or not re.fullmatch(r"-?\d+|", e):
            return None
        n += 1
        try:
            p = MEASURES[name] ** (sign * int(e or 1))
            out = p if n == 1 and "/" not in text else out * p
        except ValueError:
            return None
    return out if n else None


_MEASURE = re.compile(r"\s*([+-]?\d[\d.,' ]*(?:[eE][+-]?\d+)?)\s*(\S.*?)?\s*")


def measure(text: str, unit: str = "") -> tuple[Fraction, tuple[tuple[str, int], ...]] | None:
    """Value in canonical units and dimension of a text like ``12.5 km/h``; ``unit`` holds where the text names none."""
    m = _MEASURE.fullmatch(text or "")
    if not m:
        return None
    number, u = m[1].replace(" ", ""), unit_of(m[2] or unit)
    sign = -1 if number.startswith("-") else 1
    mantissa, _, e = number.lstrip("+-").lower().partition("e")
    value = read_number(mantissa, False)
    if u is None or value is None:
        return None
    return sign * value * Fraction(10) ** int(e or 0) * u.scale + u.offset, u.dims


def read_number(text: str, scaled: bool) -> Fraction | None:
    """A number with ``.`` ``,`` or ``'`` as decimal mark or between groups; None if the marks contradict each other.

    With both marks the last is the decimal one. A single mark before exactly three digits divides groups, unless a scale
    follows (``1,234 juta``) or the part before it is 0 or too long for a group. Groups have three digits, in the Indian
    way two, but for the last.
    """
    if text.isdigit():
        return Fraction(int(text))
    text = text.replace("'", "")
    marks = [c for c in text if c in ".,"]
    if not marks:
        return Fraction(int(text)) if text.isdigit() else None
    kinds = set(marks)
    last = marks[-1]
    head, _, tail = text.rpartition(last)
    if len(kinds) == 2:
        group = (kinds - {last}).pop()
        if last in head:
            return None
    elif len(marks) == 1:
        if len(tail) == 3 and not scaled and 1 <= len(head) <= 3 and head != "0":
            return Fraction(int(head + tail))
        group = ""
    else:
        head, tail, group = text, "", last
    parts = head.split(group) if group else [head]
    if not all(p.isdigit() for p in parts) or tail and not tail.isdigit() or not (tail or len(marks) > 1):
        return None
    if len(parts) > 1 and (not 1 <= len(parts[0]) <= 3 or len(parts[-1]) != 3 or {len(p) for p in parts[1:-1]} - {3} and {len(p) for p in parts[1:-1]} - {2}):
        return None
    whole = int("".join(parts))
    return Fraction(whole * 10 ** len(tail) + int(tail or 0), 10 ** len(tail))


def _words() -> dict[str, tuple[str, object]]:
    out: dict[str, tuple[str, object]] = {}
    for cur, names in MAJOR.items():
        out |= {n: ("unit", _base(cur)) for n in names}
    for cur, names in MINOR.items():
        out |= {n: ("unit", _base(cur, HUNDREDTH)) for n in names}
    out |= {n: ("scale", s) for n, s in SCALES.items()}
    return out | {n: ("label", None) for n in LABELS}


WORDS = _words()
_ALTS = "|".join(re.escape(w) + (r"(?![a-z])" if w[-1].isalpha() else r"(?!\d)" if w[-1].isdigit() else "") for w in sorted(WORDS, key=len, reverse=True))
_TOKEN = re.compile(rf"\s*(?:(?P<end>/[-=]|[.,]-)|(?P<word>{_ALTS})|(?P<num>\d+(?:[.,']\d+)*)|(?P<sign>-)(?=\s*\D{{0,4}}\d)|(?P<mark>[:.()*]))", re.I)


@lru_cache(maxsize=1 << 16)
def amount(text: str | None, source_currency: str | None) -> tuple[str, Fraction] | None:
    """(currency, millionths of its main unit, exact whatever their size or decimals) of a text that holds one amount, else None.

    Grammar: ``amount = label* part+``, ``part = unit? number scale? unit? end?``. A unit before a number holds if none
    follows it. A second part is only read as the hundredths of the first (``12 pounds 5 pence``). A bare ``$``, ``cents``,
    ``c`` or no unit at all mean the source's currency. Any other word or mark makes the text unreadable.
    """
    if not text:
        return None
    s, at = text.strip(), 0
    parts: list[list] = []  # number text, scale, unit after it
    before: Unit | None = None
    stated: list[Unit] = []
    negative = False
    while at < len(s):
        m = _TOKEN.match(s, at)
        if not m or m.end() == at:
            return None
        at = m.end()
        kind = m.lastgroup
        if kind == "num":
            parts.append([m["num"], 1, None])
        elif kind == "sign":
            negative = True
        elif kind == "word":
            word = m["word"].lower()
            what, value = WORDS[word]
            if what == "scale":
                if not parts or parts[-1][1] != 1:
                    return None
                parts[-1][1] = value
            elif what == "unit":
                if not parts:
                    before = value if before is None or before.dims[0][0] == SOURCE else before
                    stated.append(value)
                elif parts[-1][2] is None:
                    parts[-1][2] = value
                    stated.append(value)
                else:
                    return None
    if not parts or len(parts) > 2:
        return None
    named = {u.dims[0][0] for u in stated} - {SOURCE}
    if len(named) > 1:
        return None
    currency = named.pop() if named else source_currency
    if not currency:
        return None
    total = Fraction(0)
    for i, (number, scale, unit) in enumerate(parts):
        value = read_number(number, scale != 1)
        if value is None:
            return None
        factor = (unit or (before if before is not None and not i else None) or _base(SOURCE)).scale
        if i and not (factor == HUNDREDTH and parts[0][2] is not None and parts[0][2].scale == 1 and scale == 1 and value < 100 and value.denominator == 1):
            return None
        total += value * scale * factor
    total *= 10**6
    return currency, -total if negative else total


def decimal_parts(value: Fraction) -> tuple[str, int]:
    """(digits, k) with value = digits / 10^k; what is below the twelfth decimal is cut off."""
    k = 0
    while value.denominator > 1 and k < 12:
        k, value = k + 1, value * 10
    return str(math.floor(value)), k
