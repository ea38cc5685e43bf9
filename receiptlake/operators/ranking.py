"""Ranks within classes of any size, without one task ever ordering a whole class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one window partition holds, about.
BUCKET = 50_000


def ranked_in(df: DataFrame, classes: list[str], bucket: Column, order: list[Column], out: str = "rank") -> DataFrame:
    """df with the rank, from 1, within each class, in an order of which ``bucket`` is a coarse, never falling part.

    The counts of classes and buckets, summed in order, give the first rank of a bucket; a window orders within it. A class
    that a third of all rows have is spread over all buckets.
    """
    placed = df.withColumn("_b", bucket)
    counts = placed.groupBy(*classes, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(classes)], F.col("_b").alias("_q"), (F.sum("_n").over(Window.partitionBy(*classes).orderBy("_b")) - F.col("_n")).alias("_before"))
    on = F.col("_b") == F.col("_q")
    for i, c in enumerate(classes):
        on = on & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    numbered = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*classes, "_b").orderBy(*order)))
    return numbered.join(before, on).withColumn(out, F.col("_r") + F.col("_before")).drop("_b", "_q", "_r", "_before", *[f"_c{i}" for i in range(len(classes))])


def ranked(df: DataFrame, classes: list[str], key: str, n: int, bucket_rows: int = BUCKET) -> DataFrame:
    """df with ``rank`` within each class in an order of hashes of key (unique in df); n: about the rows of df."""
    buckets = max(1, -(-n // bucket_rows))
    order = [F.xxhash64(key, F.lit(7)), F.col(key)]
    if buckets == 1:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*classes).orderBy(*order)).cast("long"))
    return ranked_in(df, classes, F.pmod(F.xxhash64(key), F.lit(buckets)), order)
