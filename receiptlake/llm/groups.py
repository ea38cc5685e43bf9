"""Groups of rows that tasks take one at a time, and what is done when one is too large for a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one group that a task may hold; a larger group is cut into parts of about this size.
HELD = 20_000


def salted(df: DataFrame, key: str, held: int = HELD) -> DataFrame:
    """df with ``part``: 0 for groups of at most ``held`` rows, else parts by a hash of the row. Sizes are counted before
    anything is moved, combined in the map stage; only the large groups' keys are joined back."""
    large = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > held).select(F.col(key).alias("_k"), F.ceil(F.col("_n") / held).cast("int").alias("_parts"))
    rest = [c for c in df.columns if c != key]
    got = df.join(large, F.col(key) == F.col("_k"), "left")
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rest), F.col("_parts")) + 1)
    return got.select(*df.columns, part.cast("int").alias("part"))


def by_group(df: DataFrame, key: list[str], columns: list[str], per_group: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """per_group over the rows (as tuples of columns) of each group, groups sorted into partitions and held one at a time.

    Unlike a grouped-map function this starts no data frame for each group, of which most are small.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, out = None, [], []
        for pdf in parts:
            keys = zip(*(pdf[k] for k in key))
            for k, row in zip(keys, zip(*(pdf[c] for c in columns))):
                if k != at:
                    if rows:
                        out += per_group(rows)
                    at, rows = k, []
                rows.append(row)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if rows:
            out += per_group(rows)
        yield pd.DataFrame(out, columns=names)

    return df.select(*dict.fromkeys([*key, *columns])).repartition(*key).sortWithinPartitions(*key).mapInPandas(run, schema)
