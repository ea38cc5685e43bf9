"""Exact set-similarity joins with prefix, length and position filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def ranked_sets(sets: DataFrame) -> DataFrame:
    """(id, toks): each set of ``tokens`` (array<bigint>) in one global order, the rarest first, ties by token.

    Counts are made over all sets, combined before the shuffle.
    """
    each = sets.select("id", F.explode(F.array_distinct("tokens")).alias("tok"))
    freq = each.groupBy("tok").agg(F.count("*").alias("f"))
    return each.join(freq, "tok").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("o")).select("id", F.col("o.tok").alias("toks"))


def _prefix(sets: DataFrame, threshold: float) -> DataFrame:
    """Any set similar to this one shares a token of its first size - ceil(t * size) + 1."""
    n = F.size("toks")
    keep = n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1
    return sets.select("id", n.alias("n"), F.posexplode(F.slice("toks", F.lit(1), keep)).alias("pos", "tok"))


def candidates(index: DataFrame, probe: DataFrame, threshold: float, extra: Column | None = None) -> DataFrame:
    """(a, b): pairs of an index set and a probe set whose Jaccard similarity may reach the threshold; both ranked alike.

    Length filter: |b| lies between t * |a| and |a| / t. Position filter: what both sets have left behind the shared token
    could still reach the overlap. Tokens that many sets have come last in the order and so are rarely in a prefix.
    """
    a, b = _prefix(index, threshold), _prefix(probe, threshold)
    a = a.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), "tok")
    b = b.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "tok")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - F.lit(1e-9))
    on = (
        (F.col("nb") >= F.lit(threshold) * F.col("na") - F.lit(1e-9))
        & (F.col("na") >= F.lit(threshold) * F.col("nb") - F.lit(1e-9))
        & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)
    )
    got = a.join(b, "tok").where(on)
    return (got if extra is None else got.where(extra)).select("a", "b").distinct()


def verified(pairs: DataFrame, index: DataFrame, probe: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose Jaccard similarity reaches the threshold."""
    got = pairs.join(index.select(F.col("id").alias("a"), F.col("toks").alias("ta")), "a").join(probe.select(F.col("id").alias("b"), F.col("toks").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return got.select("a", "b", (both / (F.size("ta") + F.size("tb") - both)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def bipartite(index: DataFrame, probe: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for (id, tokens) sets on two sides; ids of the sides are apart. Empty sets have no partner."""
    both = index.select(F.lit(0).alias("side"), "id", "tokens").union(probe.select(F.lit(1).alias("side"), "id", "tokens")).where("size(tokens) > 0")
    ranked = cut(ranked_sets(both.select(F.struct("side", "id").alias("id"), "tokens")).select("id.side", "id.id", "toks"), "sets")
    a, b = ranked.where("side = 0").select("id", "toks"), ranked.where("side = 1").select("id", "toks")
    return verified(candidates(a, b, threshold), a, b, threshold)


def self_join(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, for (id, tokens) sets."""
    ranked = cut(ranked_sets(sets.where("size(tokens) > 0")), "sets")
    return verified(candidates(ranked, ranked, threshold, F.col("a") < F.col("b")), ranked, ranked, threshold)
