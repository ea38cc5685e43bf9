"""Reading texts that pack several values: where delimiters stand outside quotes, brackets and escapes."""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

# Candidate delimiters by name, as patterns. Longer ones come first where one holds another.
CANDIDATES = {
    "separator": r"\x1f|\x1e",
    "lines": r"\r\n|\r|\n|\\r\\n|\\n",
    "tab": r"\t|\\t",
    "double bar": r"\|\|",
    "bar": r"\|",
    "semicolon": r";",
    "wide comma": r"[、，；]",
    "plus": r"(?<=\s)\+(?=\s)",
    "slash": r"(?<=\s)/(?=\s)",
    "comma": r",(?!\d)|(?<!\d),|,(?=\d+\s?[xX]\s)",
    "and": r"(?<=\s)&(?=\s)",
    "with": r"w/",
    "at": r"@",
    "dash": r"(?<=\s)[-–](?=\s)",
    "colon": r":(?=\s)",
}
#: Quotes only open at the start of a piece; brackets and escapes hold anywhere.
_QUOTED = re.compile(r"""\s*(?:"((?:[^"\\]|""|\\.)*)"|'((?:[^'\\]|''|\\.)*)')\s*(?=$|[;,|+/\t\r\n、，；]|\\n)""")
_BRACKET = r"\([^()]*\)|\[[^\[\]]*\]"
_ESCAPE = r"\\[^nrt]"
_BULLET = re.compile(r"\s*([•·●▪*–-])(?=\s)")
_BULLETS = "•·●▪*–-"
_NUMBERED = re.compile(r"\s*\d{1,3}[.)]\s")
_NUMBER = re.compile(r"(?:^|(?<=\s))(\d{1,3})[.)]\s+")
_HEAD = re.compile(r"\s*(?:\d+\s?[xX]\s+)?(\w+)(?:\s+(?![xX]\d)(\w+))?")


@lru_cache(maxsize=4096)
def scanner(names: tuple[str, ...]) -> re.Pattern:
    parts = [f"(?P<k{i}>{CANDIDATES[n]})" for i, n in enumerate(CANDIDATES) if n in names]
    return re.compile("|".join([_BRACKET, _ESCAPE, *parts]))


@lru_cache(maxsize=4096)
def _bare(names: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<k{i}>{CANDIDATES[n]})" for i, n in enumerate(CANDIDATES) if n in names))


_NAMES = list(CANDIDATES)
#: What makes a delimiter's place matter: quotes, escapes, and brackets with more than words in them.
_GUARD = re.compile(r"""["'\\\[]|\([^()\w]*\w*[^()\w]""")


def pieces(text: str, names: tuple[str, ...]) -> list[tuple[str, str | None, bool]]:
    """(piece, name of the delimiter before it, whether it was quoted), as they stand, empty ones too."""
    if not _GUARD.search(text):
        out, start, before = [], 0, None
        for m in _bare(names).finditer(text):
            out.append((text[start : m.start()], before, False))
            before, start = _NAMES[int(m.lastgroup[1:])], m.end()
        out.append((text[start:], before, False))
        return out
    scan, out, start, before, n = scanner(names), [], 0, None, len(text)
    while True:
        if q := _QUOTED.match(text, start):
            value = q[1].replace('""', '"') if q[1] is not None else q[2].replace("''", "'")
            m = scan.match(text, q.end()) if q.end() < n else None
            if q.end() >= n or m and m.lastgroup:
                out.append((value, before, True))
                if q.end() >= n:
                    return out
                before, start = _NAMES[int(m.lastgroup[1:])], m.end()
                continue
        at = start
        while m := scan.search(text, at):
            if m.lastgroup:
                break
            at = m.end()
        if not m:
            out.append((text[start:], before, False))
            return out
        out.append((text[start : m.start()], before, False))
        before, start = _NAMES[int(m.lastgroup[1:])], m.end()


def head(piece: str) -> str:
    """The type of a piece: its first two words behind any count."""
    m = _HEAD.match(piece)
    return f"{m[1]} {m[2] or ''}".lower() if m else ""


def whole_list(text: str) -> list[str] | None:
    """The strings of a text that is one JSON array, else None."""
    s = text.strip()
    if not (s.startswith("[") and s.endswith("]")):
        return None
    try:
        got = json.loads(s)
    except ValueError:
        return None
    return [x if isinstance(x, str) else json.dumps(x) for x in got if x is not None]


def unnumbered(text: str) -> list[str]:
    """``1) a 2) b`` in its parts, if the numbers run from 1; else the text itself."""
    found, want = [], 1
    for m in _NUMBER.finditer(text):
        if int(m[1]) == want:
            found.append(m)
            want += 1
    if not found or text[: found[0].start()].strip():
        return [text]
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [text[m.end() : e] for m, e in zip(found, ends)]


def unbulleted(text: str) -> list[str]:
    m = _BULLET.match(text)
    if not m:
        return [text]
    return re.split(rf"(?:^|(?<=\s)){re.escape(m[1])}\s", text[m.start(1) :])


def items(text: str | None, names: tuple[str, ...]) -> list[str]:
    """The non-empty values packed in text, in order, by the delimiters of that name."""
    if not text:
        return []
    listed = whole_list(text)
    if listed is not None:
        return [s for x in listed if (s := x.strip())]
    out: list[str] = []
    counted = 0
    for piece, _, quoted in pieces(text, names):
        if quoted:
            if s := re.sub(r"\\(.)", r"\1", piece).strip():
                out.append(s)
            continue
        bare = piece.strip()
        for part in unbulleted(piece) if bare[:1] in _BULLETS else (piece,):
            if _NUMBERED.match(part):
                split = unnumbered(part)
                if split == [part] and (m := _NUMBER.match(part.lstrip())) and int(m[1]) == counted + 1:
                    split = [part.lstrip()[m.end() :]]
            else:
                split = (part,)
            for s in split:
                s = (re.sub(r"\\([^nrt])", r"\1", s) if "\\" in s else s).strip()
                if s:
                    out.append(s)
                    counted += 1
    return out


def evidence(text: str, start_heads: Counter, after: Counter, pieces_behind: Counter) -> None:
    """Counts, for one text, the type of its first piece, the types of the pieces behind each candidate, and how many they are."""
    if whole_list(text) is not None:
        return
    for i, (piece, by, _) in enumerate(pieces(text, tuple(CANDIDATES))):
        if not piece.strip():
            continue
        h = head(piece)
        if by is None or i == 0:
            start_heads[h] += 1
        else:
            after[by, h] += 1
            pieces_behind[by] += 1
