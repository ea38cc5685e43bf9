"""Marks that tools and people put before and behind the names of images, mined from names that are there with and without them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import imagenames

#: A mark counts if it was seen beside this many different names, and in this share of all names, so that there are at most as many
#: marks as the places of a name divided by that share.
SUPPORT, COMMON = 3, 1e-4
#: And this share of the places where it stands must leave a name that is there; of a bare number, which may as well end a name, more.
SHARE, OF_NUMBERS = 0.1, 0.5


def _marks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        yield pd.DataFrame([m for p in pdf["path"] for m in imagenames.marks(p)], columns=["kind", "h", "mark"])


def mined(df: DataFrame, path: str) -> tuple[frozenset[str], frozenset[str]]:
    """(marks before, marks behind) names, from all paths of df.

    Every name is taken apart at each place where it may have been added to; what is left must be a name of its own, numbered
    and present. Names are compared by hash of their words. What isn't a mark, such as a word of the original's own name, is
    not seen with and without it.
    """
    rows = cut(df.select(F.col(path).alias("path")).where("length(trim(path)) > 0").distinct().mapInPandas(_marks, "kind string, h long, mark string").distinct(), "marks")
    n = rows.where("kind = 'from front'").count()
    out = []
    for kind, end in (("before", "from end"), ("behind", "from front")):
        names = rows.where(F.col("kind") == end).select("h", F.lit(1).alias("there"))
        seen = rows.where(F.col("kind") == kind).join(names, "h", "left").groupBy("mark").agg(F.count("there").alias("n"), F.count("*").alias("places"))
        share = F.when(F.regexp_like("mark", F.lit(r"^\d+$")), OF_NUMBERS).otherwise(SHARE)
        found = {r.mark for r in seen.where((F.col("n") >= max(SUPPORT, COMMON * n)) & (F.col("n") >= share * F.col("places"))).collect()}
        out.append(frozenset(m for m in found if not (m.startswith("# ") and m[2:] in found)))  # the word is the mark, the number the name's
    return out[0], out[1]
