"""Splits that keep related records together: groups by union-find, then largest first to the split furthest below target."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import alterations, imagenames
from ..operators.ranking import ranked
from .unionfind import components

TARGETS = {"train": 0.8, "val": 0.1, "test": 0.1}


def original_name(path: Column | str, marks: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())) -> Column:
    """The name of the image that a file goes back to; without any marks the file's own name, written one way."""

    def originals(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for paths in parts:
            yield pd.Series([imagenames.original(p, *marks) for p in paths], dtype="object")

    return F.pandas_udf(originals, "string")(path)


def grouped(df: DataFrame, key: str, links: dict[str, Column]) -> DataFrame:
    """(key, grp): rows that share the value of any link, directly or through others, have the same grp.

    links: by name, an expression whose equal values relate rows; nulls relate nothing. A row without any value is a group
    of its own. The graph has the distinct values as nodes, and an edge where a row has two, so a value that a third of all
    rows share is one node, not a clique.
    """
    names = list(links)
    rows = df.select(F.col(key).alias("_k"), *[F.when(x.isNotNull(), F.concat(F.lit(f"{n.strip()}:"), x.cast("string"))).alias(f"_l{i}") for i, (n, x) in enumerate(links.items())])
    cols = [f"_l{i}" for i in range(len(names))]
    rows = cut(rows, "links").withColumn("_first", F.coalesce(*cols))
    if len(cols) > 1:
        edges = rows.select("_first", F.explode(F.array(*cols[1:])).alias("_o")).where("_o IS NOT NULL AND _o <> _first").distinct()
        comp = components(edges.select(F.col("_first").alias("u"), F.col("_o").alias("v")))
        rows = rows.join(comp, F.col("_first") == F.col("node"), "left")
    else:
        rows = rows.withColumn("component", F.lit(None).cast("string"))
    return rows.select(F.col("_k").alias(key), F.coalesce("component", "_first", F.concat(F.lit("row:"), F.col("_k").cast("string"))).alias("grp"))


def pairs(groups: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b): all pairs of rows with the same grp, the smaller key first. As many rows as there are pairs."""
    a, b = groups.select(F.col(key).alias(f"{key}_a"), "grp"), groups.select(F.col(key).alias(f"{key}_b"), F.col("grp").alias("_g"))
    return a.join(b, (F.col("grp") == F.col("_g")) & (F.col(f"{key}_a") < F.col(f"{key}_b"))).select(f"{key}_a", f"{key}_b")


def quotas(classes: list[tuple[str, int, int]], targets: dict[str, float]) -> list[tuple[str, int, str, int, int]]:
    """(stratum, size, split, first rank, last rank) from (stratum, size of its groups, number of them).

    Each stratum on its own, the largest groups first; each goes to the split furthest below its target, in records. Groups
    of equal size are dealt out together with the same result as one by one, in steps that don't grow with their number.
    """
    out = []
    by: dict[str, list[tuple[int, int]]] = {}
    for stratum, size, n in classes:
        by.setdefault(stratum, []).append((size, n))
    whole = sum(targets.values())
    for stratum, sizes in sorted(by.items()):
        total = sum(s * n for s, n in sizes)
        lack = {k: total * v / whole for k, v in targets.items()}
        for size, n in sorted(sizes, reverse=True):
            give = dict.fromkeys(targets, 0)
            # one by one the largest of lack - j * size is taken; those above this level are taken for certain, whatever the order
            order = sorted(lack.values(), reverse=True)
            level = size + next((x for i in range(len(order), 0, -1) if (x := (sum(order[:i]) - size * n) / i) <= order[i - 1]), order[0])
            for k, v in lack.items():
                give[k] = max(0, math.ceil((v - level) / size))
                lack[k] -= size * give[k]
            for _ in range(n - sum(give.values())):
                k = max(targets, key=lambda x: lack[x])
                give[k] += 1
                lack[k] -= size
            at = 1
            for k in targets:
                if give[k]:
                    out.append((stratum, size, k, at, at + give[k] - 1))
                    at += give[k]
    return out


def assigned(members: DataFrame, stratum: str | None = None, targets: dict[str, float] = TARGETS) -> DataFrame:
    """grp and its split, for (grp, stratum) rows, one a record.

    A group counts for the stratum that most of its records have (the least name on a tie); null is a stratum too. Groups
    of one stratum and size form a class; only the classes go to the driver, of which there are at most strata times the
    root of twice the records, since sizes differ and add up to the records. Within a class groups are ranked by hash.
    """
    spark = members.sparkSession
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("\x00null")) if stratum else F.lit("")
    per = members.select("grp", s.alias("s")).groupBy("grp", "s").agg(F.count("*").alias("n"))
    groups = cut(per.groupBy("grp").agg(F.sum("n").alias("size"), F.max(F.struct("n", F.expr("s"))).alias("m"), F.min_by("s", F.struct(-F.col("n"), "s")).alias("stratum")).select("grp", "size", "stratum"), "groups")
    n = groups.count()
    classes = [(r[0], r[1], r[2]) for r in groups.groupBy("stratum", "size").agg(F.count("*")).collect()]
    share = spark.createDataFrame(quotas(classes, targets), "q_stratum string, q_size long, split string, first long, last long")
    on = (F.col("stratum") == F.col("q_stratum")) & (F.col("size") == F.col("q_size")) & F.col("rank").between(F.col("first"), F.col("last"))
    return ranked(groups, ["stratum", "size"], "grp", n).join(share, on).select("grp", "split")


def image_links(path: str, marks: tuple[frozenset[str], frozenset[str]]) -> dict[str, Column]:
    """Images are related by their path and their name, each written in any way, and by the name without the marks."""
    same = F.lower(F.regexp_replace(F.trim(F.col(path)), r"\\", "/"))
    own, base = original_name(path), original_name(path, marks)
    # names are one kind of value, so that a name with marks meets the file that has it without
    return {"path": F.when(F.length(same) > 0, same), "name": own, "name ": base}


def image_groups(df: DataFrame, key: str, path: str) -> DataFrame:
    """(key, grp) of images by what they go back to. The marks that tell altered versions are mined from the names of df; files join
    their name and that without marks, and all that hangs together is a group. Null and blank paths, and names that say
    nothing, stand alone."""
    return grouped(df, key, image_links(path, alterations.mined(df, path)))


def image_splits(df: DataFrame, key: str, path: str, label: str, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(key, grp, label, split): whole groups of related images in one split, shares and mix of labels kept close.

    Labels are compared without case, blanks around and kind of separator; null labels are a stratum. Repeated rows and
    ties have the same group and so the same split. An empty table gives no row.
    """
    clean = F.regexp_replace(F.lower(F.trim(F.col(label))), r"[\s\-]+", "_")
    groups = image_groups(df, key, path)
    rows = cut(groups.join(df.select(F.col(key).alias("_k"), clean.alias("label")).dropDuplicates(["_k"]), F.col(key) == F.col("_k")).select(key, "grp", "label"), "members")
    return rows.join(assigned(rows, "label", targets), "grp").select(key, "grp", "label", "split")
