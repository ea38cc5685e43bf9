"""Perceptual hashes as 64-bit numbers."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def median_bits(values: Column) -> Column:
    """A bigint with bit i set where value i (of up to 64) is above the median of the values."""
    ordered = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    n = F.size(ordered)
    mid = (F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(ordered, F.floor(n / 2 + 1).cast("int"))) / 2

    def packed(m: Column) -> Column:
        bits = F.transform(values, lambda x, i: F.when(x.cast("double") > m, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    return F.element_at(F.transform(F.array(mid), packed), 1)  # the median is bound once, not sorted again for each value


def from_hex(h: Column) -> Column:
    """16 hex digits as a signed bigint; null if malformed."""
    return F.when(F.regexp_like(h, F.lit("^[0-9a-fA-F]{16}$")), F.conv(h, 16, -10).try_cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - hamming(a, b) / bits


#: Near pieces of a band that a plan may list.
TABLE = 2_000


def _cuts(bands: int, bits: int = 64) -> list[tuple[int, int]]:
    at = [round(i * bits / bands) for i in range(bands + 1)]
    return list(zip(at, at[1:]))


def band_plan(n: int, distance: int, bits: int = 64) -> tuple[int, int]:
    """(bands, bits in which a band may differ) for n hashes: of two hashes within ``distance`` at least one band differs in at most
    distance // bands bits (pigeonhole). The plan with the least keys and meetings is chosen."""

    def cost(bands: int) -> float:
        width, radius = bits // bands, distance // bands
        near = sum(comb(width, i) for i in range(radius + 1))
        return n * bands * (1 + near) + n * n / 2 * bands * near / 2.0**width

    small = [b for b in range(1, min(distance + 1, bits) + 1) if sum(comb(-(-bits // b), i) for i in range(distance // b + 1)) <= TABLE]
    best = min(small, key=lambda b: (cost(b), b))
    return best, distance // best


def pieces(h: Column, bands: int) -> Column:
    """The bands of a hash, numbered."""
    out = []
    for i, (lo, hi) in enumerate(_cuts(bands)):
        mask = (1 << (hi - lo)) - 1 if hi - lo < 64 else -1
        out.append(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(h, lo).bitwiseAND(F.lit(mask).cast("bigint")).alias("piece")))
    return F.array(*out)


def near_pieces(h: Column, bands: int, radius: int) -> Column:
    """The bands of a hash and all that differ from them in at most ``radius`` bits."""
    if radius == 0:
        return pieces(h, bands)
    flips = [[sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(hi - lo), r)] for lo, hi in _cuts(bands)]
    table = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in one]) for one in flips])
    own = pieces(h, bands)
    return F.flatten(F.transform(own, lambda p: F.transform(F.element_at(table, p["band"] + 1), lambda x: F.struct(p["band"].alias("band"), p["piece"].bitwiseXOR(x).alias("piece")))))
