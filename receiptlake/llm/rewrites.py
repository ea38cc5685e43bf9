"""Other ways to write words, mined from texts that agree elsewhere."""

from __future__ import annotations

import math
from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .orgnames import damerau

#: A rewrite is kept if it was seen in this many places, if its likelihood ratio is at least this (p < 0.001), and if it is
#: this share of what the word was found to stand for.
SUPPORT, RATIO, SHARE = 3, 10.83, 0.5
#: Share of the texts that hold a word from which on it is rewritten, so that the rules are at most the words of a text divided
#: by this, whatever the corpus; rarer slips are left to the comparison of texts.
COMMON = 1e-4


def frequencies(texts: DataFrame) -> tuple[dict[str, int], int]:
    """({word: texts that hold it}, texts) of texts(tokens), for words that at least ``COMMON`` of the texts hold."""
    rows = texts.count()
    per = texts.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("f")).where(F.col("f") >= COMMON * rows)
    return {r.w: r.f for r in per.collect()}, rows


def _ratio(n: int, na: int, nb: int, nn: int) -> float:
    """Likelihood ratio of a and b standing for each other n times, out of nn pairs of which a is in na and b in nb."""
    cells = ((n, na, nb), (na - n, na, nn - nb), (nb - n, nn - na, nb), (nn - na - nb + n, nn - na, nn - nb))
    return 2 * sum(k * math.log(k * nn / (r * c)) for k, r, c in cells if k > 0)


def mined(keyed: DataFrame, known: Collection[str], freq: dict[str, int]) -> dict[str, str]:
    """{a: b}: words a that are another way to write b.

    keyed(key, tokens): texts under each key by which they agree elsewhere, tokens without repeats; freq: see ``frequencies``. Each
    text is held against the commonest way of its key: a word that only it has and one that only the other has are a pair
    if one may be short for the other (its letters in order, the first one first) or a slip of it. A pair counts once a
    key, so that repeated rows don't count. Kept are the significant pairs, from the rarer to the commoner word or to one
    that readers know written out. No pairs of texts are made, and what is shuffled is combined first. The driver gets the
    pairs in which a word mostly stands for the other, at most two for each word of freq.
    """
    ways = cut(keyed.select("key", F.array_sort("tokens").alias("tokens")).groupBy("key", "tokens").agg(F.count("*").alias("n")), "ways")
    usual = ways.groupBy("key").agg(F.max_by("tokens", F.struct("n", F.size("tokens"), "tokens")).alias("usual"), F.count("*").alias("k")).where("k > 1").select("key", "usual")
    apart = ways.join(usual, "key").select("key", F.explode(F.array_except("tokens", "usual")).alias("x"), F.array_except("usual", "tokens").alias("ys")).select("key", "x", F.explode("ys").alias("y")).where("length(x) > 1 AND length(y) > 1")
    shorter = F.length("x") <= F.length("y")
    both = apart.select("key", "x", "y", F.when(shorter, F.col("x")).otherwise(F.col("y")).alias("short"), F.when(shorter, F.col("y")).otherwise(F.col("x")).alias("long"))
    within = F.expr("long RLIKE concat('^', regexp_replace(short, '(.)', '$1.*'), '$')")
    alike = both.where((F.levenshtein("x", "y", 1) >= 0) | within).select("key", F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p"))
    pairs = cut(alike.select("key", "p.a", "p.b").distinct().groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    nn = pairs.agg(F.sum("n")).first()[0] or 0
    of_a, of_b = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    found = pairs.where(f"n >= {SUPPORT}").join(of_a, "a").where(f"n >= {SHARE} * na").join(of_b, "b")
    best: dict[str, tuple] = {}
    for r in found.collect():
        fa, fb = freq.get(r.a, 0), freq.get(r.b, 0)
        short = len(r.a) <= len(r.b) or r.a.startswith(r.b) or damerau(r.a, r.b, 1) <= 1  # a longer word is no short form
        if fa and r.a not in known and (r.b in known or fa < fb) and short and _ratio(r.n, r.na, r.nb, nn) >= RATIO:
            best[r.a] = max(best.get(r.a, (0, 0, "")), (r.n, -len(r.b), r.b))
    return {a: b for a, (_, _, b) in sorted(best.items())}
