"""Filling containers of a fixed number of tokens with texts of varying length."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..operators.ranking import ranked

CAPACITY = 2048
#: Windows of the tiers, as parts of the capacity; each divides the next, so that windows fill a container without a rest.
TIERS = (1, 2, 4, 8)
#: Containers that one training step takes.
STEP = 64


def window(tier: int, capacity: int, tiers: tuple[int, ...] = TIERS) -> int:
    """Tokens of a tier's window. Windows of a container are as many slots as the tier has of the smallest ones."""
    return capacity if tier == 0 else tiers[-1] // tiers[tier] * (capacity // tiers[-1])


def tier_of(size: int, capacity: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The tier that an item is routed to: the last whose window holds it."""
    return max(i for i in range(len(tiers)) if i == 0 or size <= window(i, capacity, tiers))


def patterns(counts: dict[int, int], capacity: int, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(tier, how many windows, [(size, how many of it in each)]) that hold exactly the items counted by size.

    Tier by tier, the longest windows first: the longest item left opens a window of its tier, which takes the longest of
    what still fits, of its own tier and then of the shorter ones, whose items fill the gap. The same filling is repeated
    as often as the counts allow, which uses up at least one size, so there are at most as many patterns as sizes and each
    takes as many steps as it has sizes: the work doesn't grow with the number of items.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        tier = tier_of(sizes[-1], capacity, tiers)
        gap, used, at = window(tier, capacity, tiers), {}, len(sizes)
        while at := bisect_right(sizes, gap, 0, at):
            s = sizes[at - 1]
            used[s] = n = min(left[s], gap // s)
            gap -= n * s
            at -= 1
        times = min(left[s] // n for s, n in used.items())
        out.append((tier, times, sorted(used.items(), reverse=True)))
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_right(sizes, s) - 1)
    return out


def places(counts: dict[int, int], capacity: int, tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple], int]:
    """Rows (size, first rank, last rank, each, first slot, slots, offset, tier) and the number of containers.

    The items of a size with ranks first..last lie in consecutive windows of ``slots`` slots, ``each`` of them in one, from
    token offset on. Windows lie one after the other, the longest first and within a tier the fullest, so that none spans
    two containers and neighbours are alike.
    """
    rows, taken, slot = [], {}, 0
    full = lambda p: sum(s * n for s, n in p[2])
    for tier, times, used in sorted(patterns(counts, capacity, tiers), key=lambda p: (p[0], -full(p))):
        offset, slots = 0, tiers[-1] // tiers[tier]
        for size, each in used:
            first = taken.get(size, 0) + 1
            taken[size] = first - 1 + times * each
            rows.append((size, first, taken[size], each, slot, slots, offset, tier))
            offset += size * each
        slot += times * slots
    return rows, -(-slot // tiers[-1])


def dealt(container: Column, steps: int) -> Column:
    """The step of a container, dealt there and back, so that every step gets as many from each stretch of alike containers."""
    turn, at = F.floor(container / steps), F.pmod(container, F.lit(steps))
    return F.when(turn % 2 == 0, at).otherwise(F.lit(steps - 1) - at)


def packed(df: DataFrame, key: str, size: Column, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """(container, step, tier, own_tier, start, key, part, first, n_tokens): where each item, or part of one, lies.

    Items are routed to the tier of the smallest window that holds them (``own_tier``); ``tier`` is that of the window they lie
    in, a longer one if they fill its gap. An item over the capacity fills containers of its own with parts of full length;
    what is left of it is an item like the others. Others are never split. Only the counts by size, at most ``capacity``
    numbers, go to the driver and only the places of the patterns come back; every item finds its place by its rank within
    its size. Steps of about ``step`` containers get as many from each tier, and alike filled ones.
    Items without tokens (null and empty texts) lie nowhere. Repeated keys are items of their own.
    """
    spark = df.sparkSession
    sized = cut(df.select(F.col(key).alias("key"), size.cast("long").alias("n"), F.monotonically_increasing_id().alias("uid")), "sized").where("n > 0")  # a filter before would measure twice
    full = F.floor(F.col("n") / capacity)
    rest = sized.select("key", "uid", (full + F.lit(1)).cast("int").alias("part"), (full * capacity).alias("first"), (F.col("n") - full * capacity).alias("size")).where("size > 0")
    counts = {r[0]: r[1] for r in rest.groupBy("size").agg(F.count("*")).collect()}
    rows, n_rest = places(counts, capacity)
    total = sum(counts.values())
    where = spark.createDataFrame(rows, "p_size long, r_first long, r_last long, each long, slot long, slots long, offset long, tier int")
    got = ranked(rest, ["size"], "uid", total).join(where, (F.col("size") == F.col("p_size")) & F.col("rank").between(F.col("r_first"), F.col("r_last")))
    o = F.col("rank") - F.col("r_first")
    slot = F.col("slot") + F.floor(o / F.col("each")) * F.col("slots")
    start = F.pmod(slot, F.lit(TIERS[-1])) * (capacity // TIERS[-1]) + F.col("offset") + F.pmod(o, F.col("each")) * F.col("size")
    own = F.lit(0)
    for i in range(1, len(TIERS)):
        own = F.when(F.col("size") <= window(i, capacity), i).otherwise(own)
    small = got.select(F.floor(slot / TIERS[-1]).alias("container"), "tier", own.alias("own_tier"), start.alias("start"), "key", "part", "first", F.col("size").alias("n_tokens"))
    long = sized.where(F.col("n") >= capacity).select("key", "uid", F.explode(F.sequence(F.lit(1), full.cast("int"))).alias("part"))
    longs = long.withColumn("one", F.lit(1)).withColumn("piece", F.struct("uid", "part"))
    n_long = sized.agg(F.coalesce(F.sum(full), F.lit(0))).first()[0]
    none = F.lit(0)
    big = ranked(longs, ["one"], "piece", n_long).select(
        (F.lit(n_rest - 1) + F.col("rank")).alias("container"), none.alias("tier"), none.alias("own_tier"), none.cast("long").alias("start"), "key", "part", ((F.col("part") - 1).cast("long") * capacity).alias("first"), F.lit(capacity).cast("long").alias("n_tokens")
    )
    steps = max(1, -(-(n_rest + n_long) // step))
    return small.union(big).select("container", dealt(F.col("container"), steps).alias("step"), "tier", "own_tier", "start", F.col("key").alias(key), "part", "first", "n_tokens")


def report(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least containers possible, unused share, and the range of steps in containers and tokens."""
    per = items.groupBy("step", "container").agg(F.sum("n_tokens").alias("t"))
    steps = per.groupBy("step").agg(F.count("*").alias("c"), F.sum("t").alias("t"))
    return steps.agg(
        F.sum("c").alias("n_containers"),
        F.sum("t").alias("n_tokens"),
        F.ceil(F.sum("t") / capacity).alias("least_containers"),
        F.round(1 - F.sum("t") / (F.sum("c") * capacity), 6).alias("unused_share"),
        F.count("*").alias("n_steps"),
        F.min("c").alias("least_in_step"),
        F.max("c").alias("most_in_step"),
        F.round(F.min(F.col("t") / F.col("c")) / capacity, 6).alias("least_step_fill"),
        F.round(F.max(F.col("t") / F.col("c")) / capacity, 6).alias("most_step_fill"),
    )


def tier_report(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(tier, window, n_windows, n_items, n_tokens, filled_tokens, unused_share) of the windows of each tier; filled_tokens are
    those of shorter tiers in their gaps."""
    wide = F.element_at(F.array(*[F.lit(window(i, capacity)) for i in range(len(TIERS))]), F.col("tier") + 1)
    each = items.withColumn("window", wide).withColumn("w", F.floor(F.col("start") / F.col("window")))
    per = each.groupBy("tier", "window", "container", "w").agg(F.count("*").alias("i"), F.sum("n_tokens").alias("t"), F.sum(F.when(F.col("own_tier") > F.col("tier"), F.col("n_tokens")).otherwise(0)).alias("f"))
    return per.groupBy("tier", "window").agg(
        F.count("*").alias("n_windows"), F.sum("i").alias("n_items"), F.sum("t").alias("n_tokens"), F.sum("f").alias("filled_tokens"), F.round(1 - F.sum("t") / (F.count("*") * F.first("window")), 6).alias("unused_share")
    )
