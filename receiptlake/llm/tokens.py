"""Encoding of whole texts with public tokenizers, in a tree whose joins only touch what can change."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files on every executor; a parameter of each operator.
FOLDER = "/opt/tokenizers"
# Fixed value: the pattern by which byte_bpe_50k cuts a text before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf of the tree, and of the first window on each side of a join.
LEAF, WINDOW = 256, 32
# Fixed value: places where the pattern cuts any text that has these characters side by side. Only characters are named whose
# class every version of Unicode agrees on.
_MARK = r"!-/:-@\[-`{-~、。〈〉《》「」『』【】！，．：；？（）\u0901-\u0903\u093e-\u094d"
CERTAIN = rf"(?<=[\p{{L}}\p{{Nd}}{_MARK}])(?=[ \n\t])|(?<=\p{{L}})(?=[\p{{Nd}}{_MARK}])|(?<=\p{{Nd}})(?=[\p{{L}}{_MARK}])|(?<=[{_MARK}])(?<!')(?=[\p{{L}}\p{{Nd}}])"


class ByteBPE:
    """A byte-level vocabulary as a monoid: ``encode(a + b) == join(encode(a), encode(b))``.

    Merges never cross the pieces the pattern cuts, so tokens on both sides of a place where the whole text is cut for
    certain don't depend on each other: where a character that isn't blank meets a blank, and where two of the classes
    letter, number and other mark meet, but for behind an apostrophe. No alternative of the pattern spans such a place, and
    what an alternative looks ahead to is blank only.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = {i: len(b) for b, i in ranks.items()}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.certain = regex.compile(CERTAIN)

    def leaf(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """The ids of a text: of its halves, down to leaves of ``leaf`` characters, joined up the tree."""
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(text[:half], self.encode(text[:half], leaf), text[half:], self.encode(text[half:], leaf))

    def join(self, a: str, ids_a: list[int], b: str, ids_b: list[int]) -> list[int]:
        """The ids of a + b from those of a and b.

        A window around the joint is encoded anew. Its tokens have settled on a side from a certain cut on outwards if the
        old tokens of that side and the new ones both break at the cut and are the same between it and the next certain
        cut outwards: both are then the tokens of whole pieces of the text. The window doubles until both sides have
        settled or it holds all of that side.
        """
        w = WINDOW
        while True:
            tail, head = a[-w:], b[:w]
            new = self.leaf(tail + head)
            start = self._settled(tail, ids_a, new, False) if len(tail) < len(a) else (0, 0)
            end = self._settled(head, ids_b, new, True) if len(head) < len(b) else (len(ids_b), len(new))
            if start and end:
                return ids_a[: start[0]] + new[start[1] : end[1]] + ids_b[end[0] :]
            w *= 2

    def _settled(self, text: str, old: list[int], new: list[int], ahead: bool) -> tuple[int, int] | None:
        """(index in old, index in new) of a place at which both may be spliced; text is the window's part of that side."""
        cuts = [m.start() for m in self.certain.finditer(text)]
        if len(cuts) < 2:
            return None
        inner, outer = (cuts[0], cuts[1]) if ahead else (cuts[-1], cuts[-2])
        if ahead:  # bytes from the joint on, in old from its start and in new back from its end
            near, far, whole = len(text[:inner].encode()), len(text[:outer].encode()), len(text.encode())
            i, j = self._reach(old, near), self._back(new, whole - near)
            m, n = self._reach(old, far), self._back(new, whole - far)
        else:
            whole = len(text.encode())
            near, far = len(text[:inner].encode()), len(text[:outer].encode())
            i, j = self._back(old, whole - near), self._reach(new, near)
            m, n = self._back(old, whole - far), self._reach(new, far)
        if None in (i, j, m, n) or old[min(i, m) : max(i, m)] != new[min(j, n) : max(j, n)]:
            return None
        return i, j

    def _reach(self, ids: list[int], size: int) -> int | None:
        """How many tokens from the start are exactly ``size`` bytes, None if none break there."""
        i = 0
        while size > 0 and i < len(ids):
            size -= self.size[ids[i]]
            i += 1
        return i if size == 0 else None

    def _back(self, ids: list[int], size: int) -> int | None:
        """The index from which on the tokens are exactly ``size`` bytes, None if none break there."""
        i = len(ids)
        while size > 0 and i:
            i -= 1
            size -= self.size[ids[i]]
        return i if size == 0 else None

    def decode(self, ids: list[int]) -> str:
        return self._bytes(ids, 0, len(ids)).decode("utf-8", errors="replace")

    def _bytes(self, ids: list[int], i: int, j: int) -> bytes:
        """The bytes of ids[i:j], those of both halves one after the other up the tree."""
        if j - i <= LEAF:
            return b"".join([self.bytes_of[x] for x in ids[i:j]])
        half = (i + j) // 2
        return self._bytes(ids, i, half) + self._bytes(ids, half, j)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def token_ids(text: Column | str, name: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """array<int> of a text by a byte-level vocabulary, no special tokens; empty for empty and for null texts."""
    path = f"{folder}/{name}.tiktoken"

    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for texts in parts:
            yield pd.Series([v.encode(t) if t else [] for t in texts], dtype="object")

    return F.pandas_udf(ids, "array<int>")(text)


def token_count(text: Column | str, name: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """How many ids ``token_ids`` gives, which are those of the whole text; without the tree, as nothing is kept."""
    path = f"{folder}/{name}.tiktoken"

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for texts in parts:
            yield pd.Series([len(v.leaf(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)


def decoded(ids: Column | str, name: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    path = f"{folder}/{name}.tiktoken"

    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for lists in parts:
            yield pd.Series(["" if x is None else v.decode(list(x)) for x in lists], dtype="object")

    return F.pandas_udf(texts, "string")(ids)


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, ids) of every row; one narrow stage without a shuffle."""
    return df.select(F.col(key), token_ids(F.col(text), name, folder).alias("ids"))


