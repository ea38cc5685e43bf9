"""What the name of an image file says of the image: which original it goes back to, whatever was done to the file since.

The words that say what was done are not listed; they are the marks that names have beside shorter names that are there too.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import xxhash

# Kinds of image files.
EXTENSION = re.compile(r"(?:\.(?:jpe?g|jpe|png|pdf|webp|tiff?|heic|heif|bmp|gif|avif|jfif))+$")
_PARTS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|[^\s_\-()\[\]+,~]+")
#: Words that a mark in front of a name may have.
PHRASE = 3


_MISREAD = str.maketrans("oilsb", "01158")


def digits_read(token: str) -> str:
    """A token with letters that stand for digits put right, words and numbers parted, and leading zeros gone.

    Such letters are those in a token that starts like a number and has no other letters, those between digits, and an
    ``o`` between a word and four digits or more.
    """
    digits = sum(c.isdigit() for c in token)
    if digits >= 2 and digits * 2 >= len(token) and re.fullmatch(r"(?:o*|[ilsb])\d[\doilsb]*", token):
        token = token.translate(_MISREAD)
    elif digits >= 3:
        token = re.sub(r"(?<=\d)[oilsb]+(?=\d)", lambda m: m[0].translate(_MISREAD), token)
        token = re.sub(r"(?<=[a-z])o+(?=\d{4})", "", token)
    return " ".join(re.sub(r"^0+(?=\d)", "", w) for w in re.findall(r"\d+|\D+", token))


def parts_of(path: str | None) -> list[tuple[str, list[str]]]:
    """The words of a file's name in order, each with what it is made of: words and numbers, put right; a bracket is one word.

    Folders, kind of separators, case, escapes, extensions and scale suffixes don't matter.
    """
    if not path:
        return []
    name = unquote(unquote(path)).replace("\\", "/").strip().lower().split("?")[0].split("#")[0].rstrip("/").rsplit("/", 1)[-1]
    while (shorter := EXTENSION.sub("", name.strip())) != name:
        name = shorter
    name = re.sub(r"(?:@\d+x)+(?=$|[\s_\-.])", "", name).replace(".", " ")
    return [(w, ["()"] if w[0] in "([" else digits_read(w).split()) for w in _PARTS.findall(name)]


def _front(words: list[str]) -> str:
    """Words in front of a name as a mark; one with digits counts by its length."""
    return " ".join("()" if w[0] in "([" else f"#{len(w)}" if any(c.isdigit() for c in w) else w for w in words)


def _behind(parts: list[str]) -> str:
    """What stands behind a name as a mark: its first word, a number with the word after it, or the last number itself."""
    if not parts[0].isdigit():
        return parts[0]
    return parts[0] if len(parts) == 1 else f"# {'#' if parts[1].isdigit() else parts[1]}"


def _numbered(parts: list[str]) -> bool:
    return any(p.isdigit() for p in parts)


def marks(path: str | None) -> list[tuple[str, int, str]]:
    """(kind, hash, mark) of a path: its name from either end (``from front``, ``from end``), and for every place at which something may
    have been put ``behind`` or ``before`` a shorter numbered name the hash of that name and the mark."""
    words = parts_of(path)
    flat = [p for _, ps in words for p in ps]
    if not flat:
        return []
    out, h = [], 0
    number = False
    for i, p in enumerate(flat):
        if i and number:
            out.append(("behind", h, _behind(flat[i:])))
        h = xxhash.xxh3_64_intdigest(p.encode(), h) & 0x7FFF_FFFF_FFFF_FFFF
        number |= p.isdigit()
    out.append(("from front", h, ""))
    h, number, at = 0, False, []
    for p in reversed(flat):
        h = xxhash.xxh3_64_intdigest(p.encode(), h) & 0x7FFF_FFFF_FFFF_FFFF
        number |= p.isdigit()
        at.append((h, number))
    out.append(("from end", h, ""))
    gone = 0
    for k in range(1, min(PHRASE, len(words) - 1) + 1):
        gone += len(words[k - 1][1])
        h, number = at[len(flat) - gone - 1]
        if number:
            out.append(("before", h, _front([w for w, _ in words[:k]])))
    return out


def original(path: str | None, before: frozenset[str] = frozenset(), behind: frozenset[str] = frozenset()) -> str | None:
    """The words of the original's name, joined by blanks; None if the path names nothing.

    Marks in front of a numbered name, and everything from the first mark behind its number on, are left out; so are brackets.
    """
    words = parts_of(path)
    while len(words) > 1:
        k = next((k for k in range(min(PHRASE, len(words) - 1), 0, -1) if _front([w for w, _ in words[:k]]) in before and _numbered([p for _, ps in words[k:] for p in ps])), 0)
        if not k:
            break
        words = words[k:]
    flat = [p for _, ps in words for p in ps]
    kept: list[str] = []
    number = False
    for i, p in enumerate(flat):
        if number and _behind(flat[i:]) in behind:
            break
        if p != "()":
            kept.append(p)
        number |= p.isdigit()
    return " ".join(kept) or None


def number_and_words(name: str | None) -> tuple[str, str]:
    """The numbers of an original's name, joined, and its words."""
    parts = (name or "").split()
    return "-".join(p for p in parts if p.isdigit()), " ".join(p for p in parts if not p.isdigit())
