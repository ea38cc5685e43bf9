"""Postal addresses of the same place, written in different ways."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import postal
from .groups import HELD, by_group, salted
from .orgnames import damerau
from .rewrites import frequencies, mined

_READ = "address string, unit string, floor string, section string, road string, post string, words array<string>, said array<string>"


def _reader(rules: dict[str, str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for a in pdf["address"]:
                number, letter, floor, road, section, post, words, said = postal.read(a, rules) or ("", "", "", "", "", "", [], [])
                out.append((a, f"{number}|{letter}" if number else "", floor, section, road, post, words, said))
            yield pd.DataFrame(out, columns=["address", "unit", "floor", "section", "road", "post", "words", "said"])

    return run


def _tokens() -> Column:
    return F.array_distinct(F.concat("words", "said", F.array("road")))


def rewrites(read: DataFrame, freq: dict[str, int]) -> dict[str, str]:
    """{a: b}: words a that are another way to write b, mined from addresses that agree elsewhere: those of one unit, section and
    road, and those of one unit, section and postcode; see ``rewrites.mined``."""
    full = read.where("unit <> '' AND section <> ''").select("unit", "section", "road", "post", _tokens().alias("tokens"))
    keys = F.array_compact(F.array(F.when(F.col("road") != "", F.xxhash64(F.lit("road"), "unit", "section", "road")), F.when(F.length("post") == 5, F.xxhash64(F.lit("post"), "unit", "section", "post"))))
    return mined(full.select(F.explode(keys).alias("key"), "tokens"), postal.KINDS, freq)


def renormalised(addresses: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """addresses(address) as read with all rewrites mined, and the rewrites.

    Addresses are read, rewrites mined, and those that hold one read again with it, which brings more addresses to agree, until no
    rewrite is new. Each round has at least one more word that is rewritten, of which there are finitely many.
    """
    read = cut(addresses.mapInPandas(_reader({}), _READ), "read")
    freq, _ = frequencies(read.select(_tokens().alias("tokens")))
    rules: dict[str, str] = {}
    while True:
        new = {a: b for a, b in rewrites(read, freq).items() if a not in rules and b != a}
        if not new:
            return read, rules
        rules |= new
        for a in rules:  # a rewrite goes to a commoner word when it is mined; a chain is followed to its end
            seen = {a}
            while (b := rules[a]) in rules and rules[b] not in seen:
                seen.add(b)
                rules[a] = rules[b]
        glued = sorted(postal.openers(new) - postal.openers({}))
        touched = F.arrays_overlap(_tokens(), F.array(*map(F.lit, sorted(new))))
        if glued:
            touched = touched | F.exists(_tokens(), lambda w: w.rlike(f"^(?:{'|'.join(glued)})"))
        again = cut(read.where(touched).select("address").mapInPandas(_reader(dict(rules)), _READ), "reread")
        read = read.where(~touched).union(again)


def _apart(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b))


class _Roads:
    """Roads by what is left of them without one or two letters, so that slips are found without comparing all."""

    def __init__(self):
        self.by: dict[str, list[int]] = defaultdict(list)

    @staticmethod
    def less(w: str) -> set[str]:
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        return {w} | one | ({x[:i] + x[i + 1 :] for x in one for i in range(len(x))} if len(w) >= 6 else set())

    def add(self, w: str, i: int) -> None:
        for x in self.less(w):
            self.by[x].append(i)

    def near(self, w: str) -> list[int]:
        return sorted({i for x in self.less(w) for i in self.by.get(x, ())})


def located(rows: list[tuple[str, str, list[str], list[str], int]]) -> list[tuple]:
    """(address, first address of its place, and for that one all postcodes, words and rows of the place, else nulls) for (address, road,
    postcodes, words, rows) of one unit and section.

    The commonest roads come first. An address joins a place of the same road unless postcode and all words speak against
    it, and one of a road up to two slips away if postcode or a word of the locality speaks for it, up to four if both do.
    """
    often: Counter = Counter()
    for r in rows:
        often[r[1]] += r[4]
    index, places, out = _Roads(), [], []
    exact: dict[str, list[int]] = defaultdict(list)
    by_post: dict[str, list[int]] = defaultdict(list)
    for address, road, posts, words, n in sorted(((a, r, tuple(p), tuple(w), n) for a, r, p, w, n in rows), key=lambda r: (-often[r[1]], r[1], -r[4], -len(r[3]), r[0])):
        own = {w for w in words if len(w) > 2}
        hit = None
        for i in exact[road]:
            _, there, known, _, _ = places[i]
            if not posts or not there or any(_apart(q, p) <= 2 for p in there for q in posts) or not own or not known or own & known:
                hit = i
                break
        for i in [i for q in posts if len(q) == 5 for i in by_post[q]] if hit is None else ():
            other, _, known, _, _ = places[i]
            if own & known and damerau(road, other, 4) <= min(4, max(len(road), len(other)) - 2):
                hit = i
                break
        if hit is None and road:
            for i in index.near(road):
                other, there, known, _, _ = places[i]
                most = 1 if min(len(road), len(other)) < 5 else 2
                edits = damerau(road, other, most)
                speaks = any(_apart(q, p) <= 1 for p in there for q in posts) or bool(own & known)
                if edits <= most and (speaks or edits <= 1 and not (own and known) and not (posts and there)):
                    hit = i
                    break
        if hit is None:
            hit = len(places)
            places.append([road, set(), set(), address, 0])
            exact[road].append(hit)
            index.add(road, hit)
        place = places[hit]
        for q in posts:
            if q not in place[1]:
                by_post[q].append(hit)
            place[1].add(q)
        place[2] |= own
        place[4] += n
        out.append((address, hit))
    first = {places[h][3]: places[h] for _, h in out}
    return [(a, places[h][3], *((sorted(first[a][1]), sorted(first[a][2]), first[a][4]) if a in first else (None, None, None))) for a, h in out]


def _located(groups: DataFrame, held: int = HELD) -> DataFrame:
    """(address, place) of (key, address, road, posts, words, n). A group too large for a task is read in parts; the places of
    the parts then meet, each with all its postcodes and words, and the places of one stand for those of the other."""
    columns, schema = ["address", "road", "posts", "words", "n"], "address string, place string, posts array<string>, words array<string>, n long"
    parts = cut(salted(groups, "key", held), "groups")
    first = cut(by_group(parts, ["key", "part"], columns, located, schema), "places")
    large = parts.where("part > 0")
    if large.isEmpty():
        return first.select("address", "place")
    heads = large.select("key", "address", "road").join(first.where("n IS NOT NULL").select("address", "posts", "words", "n"), "address")
    again = by_group(heads, ["key"], columns, located, schema).select(F.col("address").alias("_a"), F.col("place").alias("_p"))
    return first.join(again, F.col("place") == F.col("_a"), "left").select("address", F.coalesce("_p", "place").alias("place"))


def places(df: DataFrame, key: str = "entity_id", address: str = "address") -> DataFrame:
    """(key, place): rows with the same place have addresses of one location; see ``located``.

    Number, letter and floor of the unit, and the section of the road, must be the same. Only distinct texts are read,
    mined and compared; rows join their text at the end. Groups of texts are those of one unit and section, sorted into
    partitions and compared by index, in time linear in their texts; a hot one is cut into parts. Null, empty and blank addresses have no
    place and give no row. An address without number or road only equals addresses of the same words.
    """
    rows = df.select(F.col(key).alias("key"), F.col(address).alias("address")).where("length(trim(address)) > 0")
    read, _ = renormalised(rows.select("address").distinct())
    same = F.concat_ws(" ", F.lit("="), "section", "road", "post", F.array_join(F.sort_array(F.concat("words", "said")), " "))
    k = F.when((F.col("unit") == "") | (F.col("road") == ""), same).otherwise(F.concat_ws("#", "unit", "floor", "section"))
    posts = F.when(F.col("post") != "", F.array("post")).otherwise(F.array().cast("array<string>"))
    got = _located(read.select(k.alias("key"), "address", "road", posts.alias("posts"), "words", F.lit(1).cast("long").alias("n")))
    return rows.join(got, "address").select(F.col("key").alias(key), "place")


def pairs(placed: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key_a, key_b): all pairs of rows of one place."""
    a, b = placed.select(F.col(key).alias(f"{key}_a"), "place"), placed.select(F.col(key).alias(f"{key}_b"), F.col("place").alias("_p"))
    return a.join(b, (F.col("place") == F.col("_p")) & (F.col(f"{key}_a") < F.col(f"{key}_b"))).select(f"{key}_a", f"{key}_b")
