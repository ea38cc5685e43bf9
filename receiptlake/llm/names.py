"""Variant spellings of names typed by people, linked where they mean the same organisation."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import orgnames
from .groups import HELD, by_group, salted
from .rewrites import frequencies, mined
from .unionfind import components

#: Letters from which on a word may be a slip of another, and from which on two edits count beside equal words.
SLIP, TWICE = 4, 7
#: Letters from which on a word tells so much that a short word beside it may stand for several spellings.
TELLING = 6
#: Soft weighted similarity from which on two names that met are one organisation.
ALIKE = 0.6


def _parser(rules: dict[str, str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for name in pdf["name"]:
                trade, words, doubt = orgnames.parse(name, rules)
                for i, s in enumerate(orgnames.segmentations(words, doubt)):
                    out.append((name, trade, i, s))
            yield pd.DataFrame(out, columns=["name", "trade", "way", "words"])

    return run


def _tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in parts:
        yield pd.Series([orgnames.tokens(n) for n in names], dtype="object")


def trade_words(names: DataFrame) -> dict[str, str]:
    """Other ways to write the words of trades and legal forms, mined from names that have two longer words in common that are none of these."""
    texts = cut(names.select(F.pandas_udf(_tokens, "array<string>")("name").alias("tokens")), "tokens")
    long = F.filter("tokens", lambda w: (F.length(w) >= 4) & ~w.isin(sorted(orgnames.KNOWN)))
    two = F.flatten(F.transform(long, lambda x, i: F.transform(F.slice(long, i + 2, F.size(long)), lambda y: F.xxhash64(x, y))))
    freq, _ = frequencies(texts)
    found = mined(texts.where(F.size(long) > 1).select(F.explode(two).alias("key"), "tokens"), orgnames.KNOWN, freq)
    return {a: b for a, b in found.items() if b in orgnames.KNOWN}


def names_of(*columns: DataFrame) -> DataFrame:
    """(name): the distinct stored values of one-column tables that are names: not null, blank or UNKNOWN."""
    out = None
    for c in columns:
        one = c.select(F.col(c.columns[0]).alias("name")).where("length(trim(name)) > 0 AND upper(trim(name)) <> 'UNKNOWN'").distinct()
        out = one if out is None else out.union(one)
    return out.distinct()


class _Heads:
    """Full words, found by any word that may stand for them without going through all."""

    def __init__(self, twice: bool = False):
        self.twice = twice
        self.by: dict[tuple[str, str], list[str]] = defaultdict(list)
        self.all: list[str] = []

    def add(self, w: str) -> None:
        self.all.append(w)
        for i in range(1, len(w) + 1):
            self.by["start", w[:i]].append(w)
            if i >= 3:
                self.by["end", w[-i:]].append(w)
        for x in self.less(w):
            self.by["less", x].append(w)

    def less(self, w: str) -> set[str]:
        """w without up to one letter, or two where words of eight letters may differ by two edits and ``twice`` is set."""
        return _less(w, 2 if self.twice and len(w) >= 6 else 1)

    def fit(self, w: str) -> list[str]:
        if not w:
            return self.all
        found = {}
        for x in self.less(w):
            for h in self.by.get(("less", x), ()):
                found[h] = 1
        stems = [("start", w)] if len(w) <= 4 else []
        if len(w) >= 3 and w[-1] in "YI":
            stems += [("start", w[:-1]), ("end", w[:-1])]
        for s in stems:
            for h in self.by.get(s, ()):
                found[h] = 1
        return [h for h in found if orgnames.compatible(w, h)]


class _Sets:
    """Which of n things are known to be one."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _less(w: str, most: int) -> set[str]:
    """w and what is left of it without up to ``most`` letters. Words within as many edits have one of these in common."""
    out = last = {w}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def _once(rows: list[tuple[str, str, str, bool]]) -> list[tuple[str, str]]:
    """Within (profile, word, other, own) of one trade whose words have something in common without a letter: those whose words
    are at most one edit apart while the others fit. Short others join if they fit one organisation, of the same word first,
    and beside words of ``TELLING`` letters all that begin like them."""
    if len(rows) == 1 or len({r[1] for r in rows}) == 1 and not rows[0][3]:
        return []
    by: dict[str, list[int]] = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[2]].append(i)
    heads = _Heads(twice=True)
    few = len(by) <= 12
    if not few:
        for o in by:
            heads.add(o)
    fits: dict[str, list[str]] = {o: [x for x in by if x != o and orgnames.compatible(o, x)] if few else [x for x in heads.fit(o) if x != o] if o else [] for o in by}
    one, out = _Sets(len(rows)), []

    def slip(i: int, j: int) -> bool:
        return rows[i][1] == rows[j][1] or orgnames.damerau(rows[i][1], rows[j][1], 1) <= 1

    def join(i: int, j: int) -> None:
        if one.join(i, j):
            out.append((rows[i][0], rows[j][0]))

    short: dict[str, set[str]] = defaultdict(set)
    for o, own in by.items():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                if one.find(i) != one.find(j) and slip(i, j):
                    join(i, j)
        for x in fits[o]:
            if min(len(o), len(x)) < 5:
                least, most = sorted((o, x), key=lambda y: (len(y), y))
                short[least].add(most)
                continue
            for i in own:
                for j in by[x]:
                    if one.find(i) != one.find(j) and slip(i, j):
                        join(i, j)
    for o in sorted(short, key=lambda y: (-len(y), y)):
        for i in by[o]:
            fit = [j for x in short[o] for j in by[x] if slip(i, j)]
            first = [j for j in fit if rows[j][1] == rows[i][1]] or fit
            if first and len({one.find(j) for j in first}) == 1:
                join(i, first[0])
            for j in fit:
                if min(len(rows[i][1]), len(rows[j][1])) >= TELLING and o[0] == rows[j][2][0]:
                    join(i, j)
    return out


def _twice(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Within (profile, word) of one trade beside equal words: those whose words are at most two edits apart."""
    one, out = _Sets(len(rows)), []
    by: dict[str, list[int]] = defaultdict(list)
    for i, (profile, w) in enumerate(rows if len(rows) > 1 else ()):
        keys = _less(w, 2)
        for j in sorted({j for x in keys for j in by.get(x, ())}):
            if one.find(i) != one.find(j) and orgnames.damerau(w, rows[j][1], 2) <= 2 and one.join(i, j):
                out.append((rows[j][0], profile))
        for x in keys:
            by[x].append(i)
    return out


def near(profiles: DataFrame, held: int = HELD) -> DataFrame:
    """(u, v): profiles (profile, trade, words) of which one word is a slip of the other's, in the same trade.

    Words from ``SLIP`` letters on meet where they are alike without a letter, which all words do that are one edit apart, and
    are kept if the other words fit; from ``TWICE`` letters on those beside equal words also meet without two letters, which all
    do that are two edits apart. What meets is verified by edits.
    """
    words = profiles.select("profile", "trade", "words", F.explode("words").alias("w")).where(f"length(w) >= {SLIP}")
    both = cut(words.select("profile", "trade", "w", F.concat_ws(" ", F.filter("words", lambda x: x != F.col("w"))).alias("o")), "slips")
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = both.select("profile", "trade", "w", "o", F.explode(F.array_distinct(F.concat(F.array("w"), less(F.col("w"))))).alias("x"))
    once = by_group(once.select(F.xxhash64("trade", "x").alias("key"), "profile", "w", "o", (F.col("x") == F.col("w")).alias("own")), ["key"], ["profile", "w", "o", "own"], _once, "u string, v string")
    long = both.where(f"length(w) >= {TWICE}").select("profile", "w", F.xxhash64("trade", "o").alias("key"))
    sizes = salted(long, "key", held)
    twice = F.array_distinct(F.concat(F.array("w"), less(F.col("w")), F.flatten(F.transform(less(F.col("w")), less))))
    large = sizes.where("part > 0").select("profile", "w", "key", F.explode(twice).alias("x")).select("profile", "w", F.xxhash64("key", "x").alias("key"))
    return once.union(by_group(sizes.where("part = 0").select("profile", "w", "key").union(large), ["key"], ["profile", "w"], _twice, "u string, v string"))


def _gathered(rows: list[tuple[str, str, str, int]]) -> dict[str, str | None]:
    """The full word that each other word stands for, None where that is open."""
    heads = _Heads()
    of: dict[str, str | None] = {}
    for _, other, _, _ in rows:
        if other in of:
            continue
        fit = heads.fit(other)
        if len(fit) == 1 or fit and len(other) >= 5:
            of[other] = fit[0]
        elif fit or not other:
            of[other] = None
        else:
            heads.add(other)
            of[other] = other
    return of


def _group_links(rows: list[tuple[str, str, str, int]]) -> list[tuple[str, str]]:
    """Within (profile, other, trade, n) that share a word: profiles of one organisation, each linked to the first.

    Full other words are gathered around the most frequent, over all trades and within each; initials, beginnings and pet
    forms join them if they fit just one, of their trade or of all; a name without trade joins if there is just one trade.
    The time is linear in the profiles.
    """
    rows = sorted(rows, key=lambda r: (len(r[1]) < 5, -r[3], r[0]))
    of = _gathered(rows)
    groups: dict[tuple, list[str]] = defaultdict(list)
    trades: dict[str, set[str]] = defaultdict(set)
    for _, other, trade, _ in rows:
        if of[other] is not None and trade:
            trades[of[other]].add(trade)
    for profile, other, trade, _ in rows:
        h = of[other]
        if h is not None:
            groups[h, trade or (next(iter(trades[h])) if len(trades[h]) == 1 else "")].append(profile)
    of_trade: dict[str, list[tuple]] = defaultdict(list)
    for r in rows:
        of_trade[r[2]].append(r)
    if len(of_trade) > 1:
        for trade, own in of_trade.items():
            if trade and len(own) > 1:
                within = _gathered(own)
                for profile, other, _, _ in own:
                    if within[other] is not None:
                        groups["within", within[other], trade].append(profile)
    return [(g[0], x) for g in groups.values() for x in g[1:] if x != g[0]]


def _part_links(rows: list[tuple[str, str, str, str, int]]) -> list[tuple[str, str, str]]:
    """(key, u, v) within a part of (key, profile, other, trade, n): only what the rest of the group can't change, full words
    of the same trade."""
    of = _gathered([r[1:] for r in sorted((r for r in rows if len(r[2]) >= 5 and r[3]), key=lambda r: (-r[4], r[1]))])
    groups: dict[tuple, list[str]] = defaultdict(list)
    for _, profile, other, trade, _ in sorted(rows, key=lambda r: (-r[4], r[1])):
        if of.get(other) is not None and trade:
            groups[of[other], trade].append(profile)
    return [(rows[0][0], g[0], x) for g in groups.values() for x in g[1:]]


def _linked(groups: DataFrame, held: int = HELD) -> DataFrame:
    """(u, v) links of (key, profile, other, trade, n). In a group too large for a task full words are linked in parts; what
    is left of the group - one profile for each full word and trade of a part, and those with short words or without a
    trade - is linked as a whole. A profile only leaves the group in which it was linked to another, not its other groups."""
    columns = ["profile", "other", "trade", "n"]
    parts = cut(salted(groups, "key", held), "groups")
    whole = parts.where("part = 0")
    large = parts.where("part > 0")
    split = not large.isEmpty()
    if split:
        first = cut(by_group(large, ["key", "part"], ["key", *columns], _part_links, "key string, u string, v string"), "parts")
        left = large.join(first.select("key", F.col("v").alias("profile")).distinct(), ["key", "profile"], "left_anti")
        whole = whole.union(left.select(*whole.columns))
    links = cut(by_group(whole, ["key"], columns, _group_links, "u string, v string"), "links")
    return links.union(first.select("u", "v")) if split else links


def soft_similarity(u: list[tuple[str, float]], v: list[tuple[str, float]]) -> float:
    """Soft weighted similarity of two names of (word, weight): the cosine of their weights, where words that may stand for each other
    count as far as they are alike. Each word is aligned once, the heaviest first."""
    left, got = dict(v), 0.0
    for a, wa in sorted(u, key=lambda x: (-x[1], x[0])):
        best = max(((orgnames.likeness(a, b), wb, b) for b, wb in left.items()), default=(0.0, 0.0, ""))
        if best[0] > 0:
            got += wa * best[1] * best[0]
            del left[best[2]]
    size = math.sqrt(sum(w * w for _, w in u) * sum(w * w for _, w in v))
    return got / size if size else 0.0


def _weighed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    read = lambda s: [(w, float(x)) for w, x in (p.split("|") for p in s.split(" "))]
    for u, v in parts:
        yield pd.Series([soft_similarity(read(a), read(b)) for a, b in zip(u, v)], dtype="float64")


def weighed(links: DataFrame, profiles: DataFrame, total: int) -> DataFrame:
    """(u, v, score) of links(u, v) between profiles(profile, ws): rare words weigh more, by the logarithm of the names that don't have them."""
    text = F.array_join(F.transform("ws", lambda x: F.concat_ws("|", x["word"], F.round(F.log(1 + F.lit(float(total)) / x["n"]), 4).cast("string"))), " ")
    words = cut(profiles.select("profile", text.alias("t")), "weights")
    got = links.where("u <> v").distinct().join(words.select(F.col("profile").alias("u"), F.col("t").alias("tu")), "u").join(words.select(F.col("profile").alias("v"), F.col("t").alias("tv")), "v")
    return got.select("u", "v", F.pandas_udf(_weighed, "double")("tu", "tv").alias("score"))


def organisations(names: DataFrame) -> DataFrame:
    """(name, org) of names(name): names with the same org mean one organisation.

    Legal forms, branches, case, order, marks and doubled blanks don't count; the line of trade does. Words
    glued or torn are parted or joined where that gives known words. Names meet where they share a word, however many do,
    and are compared by their other words and trade; names with a slip in the word they
    would share meet where they are alike without a letter or two (``near``). All this runs over distinct profiles of words and trade,
    not names, and links form a forest; all pairs are only made by ``pairs``.
    """
    names = cut(names, "names")
    ways = cut(names.mapInPandas(_parser(trade_words(names)), "name string, trade string, way int, words array<string>"), "ways")
    plain = ways.where("way = 0")
    vocabulary = cut(plain.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    doubtful = ways.groupBy("name").agg(F.max("way").alias("m")).where("m > 0").select("name")
    several = ways.join(doubtful, "name", "left_semi")
    each = several.select("name", "trade", "way", "words", F.explode("words").alias("word")).join(vocabulary, "word", "left")
    judged = each.groupBy("name", "trade", "way", "words").agg(F.sum(F.when((F.coalesce("n", F.lit(0)) < F.when(F.col("way") == 0, 2).otherwise(1)) & (F.length("word") > 1), 1).otherwise(0)).alias("unknown"), F.sum(F.log(F.coalesce("n", F.lit(0)) + F.lit(1))).alias("score"))
    two = (F.size("words") == 2) & ((F.col("unknown") < 2) | (F.col("way") == 0))
    order = F.struct(F.col("unknown") == 0, two, F.col("way") == 0, -F.col("unknown"), F.col("score"), -F.col("way"))
    chosen = judged.groupBy("name", "trade").agg(F.max_by("words", order).alias("words"))
    read = cut(plain.join(doubtful, "name", "left_anti").select("name", "trade", "words").union(chosen), "read")
    counts = read.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    whole = read.select("name", "trade", F.explode("words").alias("word")).join(counts, "word").groupBy("name", "trade").agg(F.array_sort(F.collect_set(F.struct("word", "n"))).alias("ws"))
    named = cut(whole.select("name", "trade", "ws", F.concat_ws("|", F.col("ws.word"), F.array("trade")).alias("profile")), "named")
    profiles = cut(named.groupBy("profile").agg(F.first("ws").alias("ws"), F.first("trade").alias("trade"), F.count("*").alias("n")), "profiles")
    opened = profiles.select("profile", "trade", "n", "ws", F.explode("ws").alias("k")).where("length(k.word) >= 4 OR size(ws) = 1")
    other = F.concat_ws(" ", F.transform(F.filter("ws", lambda x: x["word"] != F.col("k.word")), lambda x: x["word"]))
    keyed = opened.select(F.col("k.word").alias("key"), "profile", other.alias("other"), "trade", "n")
    links = _linked(keyed)
    links = links.union(near(profiles.select("profile", "trade", F.col("ws.word").alias("words"))))
    comp = components(weighed(links, profiles, read.count()).where(F.col("score") >= ALIKE).select("u", "v"))
    return named.join(comp, F.col("profile") == F.col("node"), "left").select("name", F.coalesce("component", "profile").alias("org"))


def pairs(orgs: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different names of one organisation, ordered by their bytes."""
    a, b = orgs.select(F.col("name").alias("name_a"), "org"), orgs.select(F.col("name").alias("name_b"), F.col("org").alias("_o"))
    return a.join(b, (F.col("org") == F.col("_o")) & (F.col("name_a") < F.col("name_b"))).select("name_a", "name_b")


