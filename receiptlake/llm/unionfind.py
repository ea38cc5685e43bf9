"""Connected components by local forests that are merged level by level, then by star contraction where they stay large."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_table

#: Edges that one task may hold in memory as a forest (about 150 bytes each).
FOREST = 400_000
#: Partitions merged into one at each level.
FAN_IN = 8


def forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) of a partition as stars: (node, smallest node it is joined to), for nodes that aren't the smallest."""
    parent: dict = {}

    def find(x):
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    kind = None
    for pdf in parts:
        kind = pdf["u"].dtype
        for u, v in zip(pdf["u"].to_list(), pdf["v"].to_list()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        some = nodes[i : i + 50_000]
        yield pd.DataFrame({"u": pd.Series(some, dtype=kind), "v": pd.Series([find(x) for x in some], dtype=kind)})


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al. 2014); edges u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = edges.select(F.col("v").alias("c"), F.col("u").alias("w")).join(least, F.col("c") == F.col("u")).select(F.col("w").alias("u"), F.col("m").alias("v"))
    large = large.where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    pairs = large.join(low, "u").select("u", "v", "m")
    small = pairs.select("u", F.col("m").alias("v")).union(pairs.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.where("u > v").distinct()


def components(edges: DataFrame, forest_edges: int = FOREST) -> DataFrame:
    """(node, component) for every node of edges(u, v) but those that only have themselves; component is its least node.

    Level by level each task turns its edges into a forest and ``FAN_IN`` forests meet in the next task, while a task gets
    at most ``forest_edges`` edges. Graphs whose forest is larger than one task may hold go on with star contraction, whose
    rounds grow with the logarithm of the longest path. Null ends and edges from a node to itself are left out; repeated
    edges don't matter. An empty table gives an empty one.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u > v").distinct()
    e = cut(e, "edges")
    schema, written = e.schema, e
    n, parts = e.count(), max(1, e.rdd.getNumPartitions())
    wanted = max(parts, -(-n // forest_edges))
    if wanted > parts:
        e, parts = e.repartition(wanted, "v"), wanted
    while True:
        before, e = written, cut(e.mapInPandas(forest, schema), "forest")
        written = e
        drop_table(before)
        if parts == 1:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        n = e.count()
        fewer = max(1, -(-parts // FAN_IN), -(-n // forest_edges))
        if fewer >= parts:
            break
        e, parts = e.repartition(fewer, F.col("v")) if fewer > 1 else e.coalesce(1), fewer
    while True:
        after = cut(_star_round(e), "stars")
        if after.groupBy("u").count().where("count > 1").isEmpty() and after.alias("a").join(after.alias("b"), F.col("a.v") == F.col("b.u"), "left_semi").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        drop_table(e)
        e = after


