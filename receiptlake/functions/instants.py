"""One parser for dates and times as people and programs write them."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Names of months (English, Malay, Indonesian) and offsets in minutes of the zone names in use.
MONTHS = {
    "jan": 1, "january": 1, "januari": 1, "feb": 2, "february": 2, "februari": 2, "mar": 3, "march": 3, "mac": 3, "maret": 3,
    "apr": 4, "april": 4, "may": 5, "mei": 5, "jun": 6, "june": 6, "juni": 6, "jul": 7, "july": 7, "julai": 7, "juli": 7,
    "aug": 8, "august": 8, "ogos": 8, "ogo": 8, "agustus": 8, "agu": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "okt": 10, "oktober": 10, "nov": 11, "november": 11, "dec": 12, "december": 12, "dis": 12, "disember": 12, "des": 12, "desember": 12,
}
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "cet": 60, "cest": 120, "ist": 330, "pkt": 300,
    "wib": 420, "wita": 480, "wit": 540, "myt": 480, "sgt": 480, "hkt": 480, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "jst": 540,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_MON = "|".join(sorted(MONTHS, key=len, reverse=True))
_ZONE = r"(?:\(?(?:(?P<abbr>" + "|".join(sorted(ZONES, key=len, reverse=True)) + r")(?![a-z/])\s*)?(?P<off>[+-]\d{1,2}(?::?\d{2})?)?\)?|\[?(?P<iana>[a-z]+(?:/[a-z_+-]+){1,2})\]?)"
_TIME = r"(?P<h{n}>\d{{1,2}})[:.h](?P<mi{n}>\d{{2}})(?:[:.](?P<s{n}>\d{{2}})(?:[.,](?P<f{n}>\d{{1,9}}))?)?\s*(?P<ap{n}>[ap]\.?m\b\.?)?"
_DATE = (
    r"(?:(?P<y1>\d{4})(?P<sep1>[-/.])(?P<m1>\d{1,2})(?P=sep1)(?P<d1>\d{1,2})(?!\d)"
    r"|(?P<a>\d{1,2})(?P<sep2>[-/.])(?P<b>\d{1,2})(?P=sep2)(?P<y2>\d{4}|\d{2})(?!\d)"
    rf"|(?P<d3>\d{{1,2}})\s*(?:st|nd|rd|th)?[\s/.,-]*(?:of\s+)?(?P<m3>{_MON})(?![a-z])\.?[\s/.,-]*(?P<y3>'?\d{{4}}|'?\d{{2}})(?!\d)"
    rf"|(?P<m4>{_MON})(?![a-z])\.?[\s/.-]*(?P<d4>\d{{1,2}})\s*(?:st|nd|rd|th)?[\s/.,-]+(?P<y4>'?\d{{4}}|'?\d{{2}})(?![\d:])"
    rf"|(?P<y5>\d{{4}})[\s/.-]*(?P<m5>{_MON})(?![a-z])\.?[\s/.-]*(?P<d5>\d{{1,2}})(?!\d)"
    r"|(?P<y6>\d{4})\s*年\s*(?P<m6>\d{1,2})\s*月\s*(?P<d6>\d{1,2})\s*日)"
)
_LABEL = r"(?:(?:date|tarikh|tgl|tanggal|dated|time|masa)\s*[:.-]?\s*)*"
_DAY = r"(?:(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\.?\b,?\s*)?"
_FIRST = re.compile(rf"{_LABEL}{_DAY}{_DATE}(?:[\sT,@-]*?(?:at\s+)?{_TIME.format(n='')})?(?:\s*{_ZONE})?", re.I)
_LAST = re.compile(rf"{_LABEL}{_TIME.format(n='')}(?:\s*{_ZONE})?[\s,@-]+{_DAY}(?:{_DATE}|(?P<d8>\d{{8}}))", re.I)
_COMPACT = re.compile(rf"{_LABEL}{_DAY}(?P<d8>\d{{8}})(?:[\sT]*(?P<t>\d{{4}}|\d{{6}})(?:[.,](?P<f>\d{{1,9}}))?(?!\d)|[\sT]+{_TIME.format(n='2')})?(?:\s*{_ZONE})?", re.I)
_EPOCH = re.compile(r"(?:@|epoch\s*:?\s*)?(?P<e>\d{10}|\d{13}|\d{16}|\d{19})(?:\.(?P<f>\d{1,9}))?")


@lru_cache(maxsize=512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        parts = name.split("/")
        try:
            return ZoneInfo("/".join("_".join(w.capitalize() for w in p.split("_")) for p in parts))
        except (KeyError, ValueError, OSError):
            return None


def _ymd(g: dict, order: str) -> date | None:
    if g.get("d8"):
        s = g["d8"]
        trials = [(s[:4], s[4:6], s[6:]), (s[4:], s[2:4], s[:2]) if order != "mdy" else (s[4:], s[:2], s[2:4])]
        for y, m, d in trials:
            if 1900 <= int(y) < 2100 and (real := _real(int(y), int(m), int(d))):
                return real
        return None
    if g["y1"]:
        return _real(int(g["y1"]), int(g["m1"]), int(g["d1"]))
    if g["a"]:
        d, m = (g["b"], g["a"]) if order == "mdy" else (g["a"], g["b"])
        return _real(_year(g["y2"]), int(m), int(d))
    for n in "345":
        if g["m" + n]:
            return _real(_year(g["y" + n]), MONTHS[g["m" + n].lower()], int(g["d" + n]))
    return _real(int(g["y6"]), int(g["m6"]), int(g["d6"]))


def _year(text: str) -> int:
    text = text.lstrip("'")
    return int(text) if len(text) == 4 else 2000 + int(text)


def _real(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def _utc(t: datetime, ms: int) -> str:
    return f"{t:%Y-%m-%dT%H:%M:%S}.{ms:03d}Z" if t.year > 999 else f"{t.isoformat()}.{ms:03d}Z"


def moment(text: str | None, tz: str | None, order: str | None) -> str | None:
    """``YYYY-MM-DD`` for a date, ``YYYY-MM-DDTHH:MM:SS.sssZ`` for a date with a time of day, None if it is neither.

    A zone or offset in the text holds, else ``tz``; without either a time of day can't be placed and gives None.
    A local time that occurs twice is the first, a skipped one is read with the offset before the change.
    ``order`` (dmy or mdy) decides dates of numbers that end in the year; years of two digits are 20xx.
    """
    if not text:
        return None
    s = " ".join(text.split())
    if m := _EPOCH.fullmatch(s):
        e, size = int(m["e"]), len(m["e"])
        seconds, rest = divmod(e, 10 ** (size - 10))
        ms = int((str(rest).zfill(size - 10) + "000")[:3]) if size > 10 else int(((m["f"] or "") + "000")[:3])
        try:
            return _utc(datetime.fromtimestamp(seconds, UTC), ms)
        except (ValueError, OverflowError, OSError):
            return None
    m = _FIRST.fullmatch(s) or _COMPACT.fullmatch(s) or _LAST.fullmatch(s)
    if not m:
        return None
    g = m.groupdict()
    day = _ymd(g, order or "dmy")
    if day is None:
        return None
    t = g.get("t")
    if t:
        h, mi, sec = int(t[:2]), int(t[2:4]), int(t[4:] or 0)
        half = frac = None
    else:
        n = "2" if g.get("h2") else ""
        if not g.get("h" + n):
            return day.isoformat()
        h, mi, sec, half = int(g["h" + n]), int(g["mi" + n]), int(g["s" + n] or 0), g["ap" + n]
        frac = g["f" + n]
    if t:
        frac = g.get("f")
    if half:
        if not 1 <= h <= 23:
            return None
        if h <= 12:
            h = h % 12 + (12 if half[0] in "pP" else 0)
    next_day = h == 24 and mi == sec == 0
    if next_day:
        h = 0
    if h > 23 or mi > 59 or sec > 60:
        return None
    ms = int(((frac or "") + "000")[:3])
    sec, leap = min(sec, 59), sec == 60
    local = datetime(day.year, day.month, day.day, h, mi, sec)
    if g["off"]:
        digits = g["off"][1:].replace(":", "")
        minutes = int(digits) * 60 if len(digits) <= 2 else int(digits[:-2]) * 60 + int(digits[-2:])
        if minutes >= 1440:
            return None
        zone = timezone(timedelta(minutes=-minutes if g["off"][0] == "-" else minutes))
    elif g["abbr"]:
        zone = timezone(timedelta(minutes=ZONES[g["abbr"].lower()]))
    else:
        zone = _zone(g["iana"] or tz) if (g["iana"] or tz) else None
    if zone is None:
        return None
    try:
        at = (local.replace(tzinfo=zone)).astimezone(UTC) + timedelta(days=int(next_day), seconds=int(leap))
    except OverflowError:
        return None
    return _utc(at, ms)
