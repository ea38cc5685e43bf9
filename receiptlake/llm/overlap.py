"""The same or nearly the same records in evaluation and training splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import alterations, imagenames
from .setjoin import bipartite

#: Jaccard similarity of the three-letter shingles of two names with the same numbers from the same source.
SIMILAR = 0.5


def _parts(marks: tuple[frozenset[str], frozenset[str]]):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for paths in parts:
            got = [imagenames.number_and_words(imagenames.original(p, *marks)) if p else (None, None) for p in paths]
            yield pd.DataFrame(got, columns=["number", "words"])

    return run


def image_overlaps(df: DataFrame, key: str = "rec_id", path: str = "image_path", source: str = "source", split: str = "split", train: str = "train") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, names, and pairs of names: (key, split, source, name), (name, ...), (a, b, similarity) with a evaluated and b trained on.

    A name is the number, words and source of an image's original. Its shingles are three letters of the words, each bound
    to the number and source, so that shared shingles are rare and only names with the same number can be similar; a
    name without number is bound to its words and only equals itself. The join runs over distinct names: rows of one image,
    however many, are one set. Null and blank paths have no name; rows of no split or other splits than the training one
    count as evaluated, except for a null split, which is left out.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(split).alias("split"), F.pandas_udf(_parts(alterations.mined(df, path)), "number string, words string")(F.col(path)).alias("p")).where("p.words IS NOT NULL AND split IS NOT NULL AND (p.words <> '' OR p.number <> '')")
    src = F.coalesce("source", F.lit(""))
    rows = cut(rows.select("key", "split", "source", "p.number", "p.words", F.xxhash64(src, "p.number", "p.words").alias("name"), (F.col("split") == train).alias("trained")), "rows")
    names = rows.select("name", "trained", src.alias("s"), "number", "words").distinct()
    bound = F.when(F.col("number") == "", F.concat(F.lit("="), F.col("words"))).otherwise(F.col("number"))
    padded = names.select("name", "trained", "s", bound.alias("bound"), F.concat(F.lit("  "), F.col("words"), F.lit(" ")).alias("w"))
    sets = cut(padded.select("name", "trained", F.expr("transform(sequence(1, length(w) - 2), i -> xxhash64(s, bound, substring(w, i, 3)))").alias("tokens")), "names")
    a = sets.where("NOT trained").select(F.col("name").alias("id"), "tokens")
    b = sets.where("trained").select(F.col("name").alias("id"), "tokens")
    return rows, sets, bipartite(a, b, SIMILAR)


def overlapping_pairs(rows: DataFrame, names: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key_a, key_b, split, source, exact): every evaluated row with every trained row of a similar name."""
    ev = rows.where("NOT trained").select(F.col("key").alias("ek"), F.col("name").alias("a"), "split", "source")
    tr = rows.where("trained").select(F.col("key").alias("tk"), F.col("name").alias("b"))
    got = ev.join(names, "a").join(tr, "b")
    return got.select(F.least("ek", "tk").alias(f"{key}_a"), F.greatest("ek", "tk").alias(f"{key}_b"), "split", "source", (F.col("a") == F.col("b")).alias("exact"))


def overlap_report(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(split, source, n_rows, n_overlapping, n_pairs, n_exact_pairs) of the evaluated rows; pairs are counted, not made."""
    ev = rows.where("NOT trained").groupBy("split", "source", "name").agg(F.count("*").alias("n"))
    tr = rows.where("trained").groupBy("name").agg(F.count("*").alias("m")).withColumnRenamed("name", "b")
    hits = names.join(tr, "b").groupBy("a").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(0)).alias("same"))
    got = ev.join(hits, F.col("name") == F.col("a"), "left")
    return got.groupBy("split", "source").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("m").isNotNull(), F.col("n")).otherwise(0)).alias("n_overlapping"),
        F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.sum(F.col("n") * F.col("same")), F.lit(0)).alias("n_exact_pairs"),
    )
