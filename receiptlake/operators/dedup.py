"""Exact, fuzzy, cross-account and perceptual duplicates, all as keyed joins or windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from . import windows


def exact_groups(df: DataFrame, keys: dict[str, Column], member: str) -> DataFrame:
    """Groups of equal keys with more than one row: the keys, how many, the least and greatest member."""
    named = df.select(*[c.alias(k) for k, c in keys.items()], F.col(member).alias("_m"))
    return named.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min("_m").alias("first_member"), F.max("_m").alias("last_member")).where("n_rows > 1")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. The winner is picked by an aggregate, which combines before the shuffle, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def probe(df: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys are among those of probes."""
    return df.join(probes.select(*keys).distinct(), keys, "left_semi")


def fuzzy_pairs(df: DataFrame, key: str, block: list[str], amount: str, name: Column, similarity, tolerance: float = 2.0, least: float = 0.84) -> DataFrame:
    """(a, b, score): rows of one block with amounts at most ``tolerance`` apart and names that are alike.

    Blocks are cut further into amount cells as wide as the tolerance; a row meets its own cell and the next one, so that a
    hot block isn't compared with itself as a whole. The cheap test on amounts comes before the one on names.
    """
    rows = df.select(F.col(key).alias("k"), *block, F.col(amount).cast("double").alias("v"), name.alias("nm")).where("v IS NOT NULL AND nm IS NOT NULL")
    cell = F.floor(F.col("v") / tolerance)
    left = rows.select(F.col("k").alias("ka"), *block, F.col("v").alias("va"), F.col("nm").alias("na"), cell.alias("cell_a"))
    left = left.withColumn("cell", F.explode(F.array(F.col("cell_a") - 1, F.col("cell_a"), F.col("cell_a") + 1)))
    right = rows.select(F.col("k").alias("kb"), *block, F.col("v").alias("vb"), F.col("nm").alias("nb"), cell.alias("cell"))
    got = left.join(right, [*block, "cell"]).where((F.col("ka") < F.col("kb")) & (F.abs(F.col("va") - F.col("vb")) <= tolerance))
    return got.select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.round(similarity(F.col("na"), F.col("nb")), 6).alias("score")).where(F.col("score") >= least)


def first_claims(df: DataFrame, key: str, owner: str, fingerprint: Column, at: str) -> DataFrame:
    """(key, first_key, first_owner): rows whose fingerprint another owner had before; the first upload keeps it."""
    rows = df.select(F.col(key).alias("k"), F.col(owner).alias("o"), fingerprint.alias("fp"), F.col(at).alias("t")).where("o IS NOT NULL")
    first = rows.groupBy("fp").agg(F.min_by(F.struct("k", "o"), F.struct("t", "k")).alias("f"))
    return rows.join(first, "fp").where("f.o <> o").select(F.col("k").alias(key), F.col("f.k").alias("first_key"), F.col("f.o").alias("first_owner"))


def hash_pairs(df: DataFrame, key: str, h: Column, distance: int) -> DataFrame:
    """(a, b, distance): hashes within a Hamming distance, found through shared bands - no pair within it is missed.

    A hash is cut into bands, of which one of any near pair differs in few bits only; one side is keyed by its bands, the
    other by all pieces so near. How many bands there are is chosen by the number of hashes, so that what is keyed and what
    meets stays least. Rows with the same hash meet as one and are told apart at the end.
    """
    rows = df.select(F.col(key).alias("k"), h.alias("h")).where("h IS NOT NULL")
    values = rows.select("h").distinct()
    plan = hashing.band_plan(values.count(), distance)
    own = values.select(F.col("h").alias("ha"), F.explode(hashing.pieces(F.col("h"), plan[0])).alias("x")).select("ha", "x.band", "x.piece")
    near = values.select(F.col("h").alias("hb"), F.explode(hashing.near_pieces(F.col("h"), *plan)).alias("x")).select("hb", "x.band", "x.piece")
    met = own.join(near, ["band", "piece"]).where(F.col("ha") <= F.col("hb")).select("ha", "hb", hashing.hamming(F.col("ha"), F.col("hb")).alias("distance")).where(F.col("distance") <= distance).distinct()
    a, b = rows.select(F.col("k").alias("ka"), F.col("h").alias("ha")), rows.select(F.col("k").alias("kb"), F.col("h").alias("hb"))
    got = met.join(a, "ha").join(b, "hb").where("ha <> hb OR ka < kb")
    return got.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "distance")


def hash_links(df: DataFrame, key: str, h: Column, distance: int) -> DataFrame:
    """(key, n_near): how many other rows are within the distance of each, rows without any left out; no pair is made of copies."""
    rows = df.select(F.col(key).alias("k"), h.alias("h")).where("h IS NOT NULL")
    copies = rows.groupBy("h").agg(F.count("*").alias("c"))
    met = hash_pairs(copies.select("h"), "h", F.col("h"), distance)
    both = met.select(F.col("a").alias("x"), F.col("b").alias("y")).union(met.select(F.col("b").alias("x"), F.col("a").alias("y")))
    others = both.join(copies.select(F.col("h").alias("y"), F.col("c").alias("cy")), "y").groupBy("x").agg(F.sum("cy").alias("o"))
    total = copies.join(others, F.col("h") == F.col("x"), "left").select(F.col("h").alias("_h"), (F.col("c") - 1 + F.coalesce("o", F.lit(0))).alias("n_near"))
    return rows.join(total.where("n_near > 0"), F.col("h") == F.col("_h")).select(F.col("k").alias(key), "n_near")


def hash_pairs_recent(df: DataFrame, key: str, h: Column, cents: Column, seq: str, distance: int, back: int) -> DataFrame:
    """Near hashes of the same amount among at most ``back`` rows before; rows without amount never match.

    Places are cut into cells of ``back``, and a row meets its own cell and the one before, so that a common amount leads to
    as many comparisons as its rows times those of two cells.
    """
    rows = df.select(F.col(key).alias("k"), h.alias("h"), cents.alias("c"), F.col(seq).alias("s")).where("h IS NOT NULL AND c IS NOT NULL").withColumn("cell", F.floor(F.col("s") / back))
    near = F.explode(F.array(*[F.struct((F.col("c") + i).alias("c"), (F.col("cell") + j).alias("cell")) for i in (-1, 0, 1) for j in (0, 1)]))
    old = rows.select(F.col("k").alias("kb"), F.col("h").alias("hb"), F.col("s").alias("sb"), near.alias("x")).select("kb", "hb", "sb", "x.c", "x.cell")
    got = rows.join(old, ["c", "cell"]).where((F.col("s") - F.col("sb")).between(1, back))
    return got.select(F.col("k").alias("a"), F.col("kb").alias("b"), hashing.hamming(F.col("h"), F.col("hb")).alias("distance")).where(F.col("distance") <= distance).distinct()


#: References that one task holds at a time, 16 bytes each.
HELD = 50_000


def nearest(df: DataFrame, references: DataFrame, key: str, h: Column, held: int = HELD) -> DataFrame:
    """(key, ref, similarity): for each hash the most similar other one of a set of references; ties by ref.

    References fall into blocks by hash of their key, each held by one task, and every row is sent once to each block: a
    stated query set against all references, in blocks. Only the best of each block goes on. As many rows as rows times
    blocks are moved, so the references are the smaller side.
    """
    refs = references.select(F.col(key).cast("bigint").alias("ref"), h.alias("hr")).where("hr IS NOT NULL").distinct()
    blocks = max(1, -(-refs.count() // held))
    rows = df.select(F.col(key).cast("bigint").alias("k"), h.alias("h")).where("h IS NOT NULL")
    slices = max(1, df.sparkSession.sparkContext.defaultParallelism // blocks)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("ref")
        ids, hashes, keys, own = right["ref"].to_numpy(), right["hr"].to_numpy(), left["k"].to_numpy(), left["h"].to_numpy()
        got = []
        for lo in range(0, len(keys) if len(ids) else 0, 256):
            k = keys[lo : lo + 256]
            d = np.bitwise_count((own[lo : lo + 256, None] ^ hashes[None, :]).view(np.uint64)).astype(np.int64)
            d[k[:, None] == ids[None, :]] = 65
            i = d.argmin(axis=1)
            got.append(pd.DataFrame({"k": k, "ref": ids[i], "d": d[np.arange(len(k)), i]}))
        return pd.concat(got) if got else pd.DataFrame({"k": [], "ref": [], "d": []}).astype("int64")

    by_block = refs.select(F.pmod(F.xxhash64("ref"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "ref", "hr")
    each = rows.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.pmod(F.xxhash64("k"), F.lit(slices)).cast("int").alias("slice"), "k", "h")
    found = each.groupBy("block", "slice").cogroup(by_block.groupBy("block", "slice")).applyInPandas(best, "k bigint, ref bigint, d bigint").where("d <= 64")
    top = found.groupBy("k").agg(F.min(F.struct("d", "ref")).alias("m"))
    return top.select(F.col("k").alias(key), F.col("m.ref").alias("ref"), F.round(1 - F.col("m.d") / 64, 6).alias("similarity"))


def in_tiers(df: DataFrame, targets: DataFrame, tiers: list[tuple[Column, Column]], key: str, target: str) -> DataFrame:
    """(key, target, tier): the first tier of equal keys that finds a target; of several the least. One equi-join a tier."""
    out = None
    for i, (own, theirs) in enumerate(tiers):
        a = df.select(F.col(key).alias("k"), own.alias("j")).where("j IS NOT NULL AND j <> ''")
        b = targets.select(F.col(target).alias("t"), theirs.alias("j")).where("j IS NOT NULL AND j <> ''").groupBy("j").agg(F.min("t").alias("t"))
        one = a.join(b, "j").select("k", "t", F.lit(i + 1).alias("tier"))
        out = one if out is None else out.union(one)
    return out.groupBy("k").agg(F.min(F.struct("tier", "t")).alias("m")).select(F.col("k").alias(key), F.col("m.t").alias(target), F.col("m.tier").alias("tier"))


def running_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows numbered in their group, for reports that keep the order of uploads; no task orders a whole group."""
    return windows.numbered(df, by, order, "_n").withColumn("nth", F.col("_n").cast("int")).drop("_n")


def listed_groups(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, line, nth, n_rows): the lines of groups of equal keys with more than one row, one row each, in order; the keys sorted
    first. A group is never collected, so it may be of any size."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    on = None
    for k in keys:
        same = df[k].eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    rows = df.join(sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], "n_rows"), on).select(*keys, line, "n_rows")
    return windows.numbered(rows, keys, [line], "nth").select(*keys, line, "nth", "n_rows")
