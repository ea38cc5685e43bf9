"""Profiles of tables: counts, crosstabs, missing values, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by the given values of column, as columns n_<value>; values are named so that no pass looks for them."""
    return df.groupBy(F.col(row).alias("row_value")).agg(*[F.count_if(F.col(column) == v).alias(f"n_{i}_{v}".replace(" ", "_")) for i, v in enumerate(values)], F.count("*").alias("n_all"))


def missing(c: str, also: tuple[str, ...] = ()) -> Column:
    """Null, blank, or one of the words that stand for nothing."""
    t = F.trim(F.col(c).cast("string"))
    cond = F.col(c).isNull() | (t == "")
    return cond | F.upper(t).isin(*also) if also else cond


def missing_rates(df: DataFrame, columns: list[str], also: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(column_name, n_missing, missing_pct): one pass over the table, then one row a column."""
    also = also or {}
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(missing(c, also.get(c, ())), F.lit(True))).alias(c) for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns])
    return one.select("n", F.explode(parts).alias("p")).select("p.column_name", "p.n_missing", F.round(F.col("p.n_missing") * 100.0 / F.greatest("n", F.lit(1)), 3).alias("missing_pct"))


def missing_by_group(df: DataFrame, group: str, columns: list[str], also: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    also = also or {}
    return df.groupBy(F.col(group).alias("grp")).agg(*[F.round(F.avg(F.coalesce(missing(c, also.get(c, ())), F.lit(True)).cast("double")) * 100, 3).alias(f"{c}_missing_pct") for c in columns])


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct), exact, in one scan: values of all columns side by side, combined before the shuffle."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.i", "x.v")
    per = each.groupBy("i", "v").agg(F.lit(1).alias("x")).groupBy("i").agg(F.count("v").alias("n_distinct"))
    return per.select(F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1).alias("column_name"), "n_distinct")


def repeats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, distinct keys, and how many rows repeat an earlier one; nulls equal each other."""
    per = df.groupBy(*columns).agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_repeats"))


def conditional_counts(df: DataFrame, by: str, conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def conflicting(df: DataFrame, key: Column, value: str) -> DataFrame:
    """(grp, n_values, value_list): groups whose rows have more than one value."""
    got = df.select(key.alias("grp"), F.col(value).alias("v")).where("grp IS NOT NULL AND v IS NOT NULL").distinct().groupBy("grp")
    return got.agg(F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_list("v")), ",").alias("value_list")).where("n_values > 1")


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of the values within [low, high)."""
    w = (high - low) / bins
    return df.select(F.floor((value - low) / w).cast("int").alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))


def dominant_bins(df: DataFrame, value: Column, low: float, high: float, bins: int, share: float = 0.1) -> DataFrame:
    """(bin, n, share): the bins that hold more than a share of the values within [low, high)."""
    h = histogram(df, value, low, high, bins)
    total = h.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return h.select("bin", "n", F.round(F.col("n") / max(total, 1), 6).alias("share")).where(F.col("n") > share * total)


#: Percentiles, in per cent, that profiles give, by linear interpolation.
PERCENTILES = (2.0, 2.5, 50.0, 95.0, 97.5, 98.0, 99.0)


def moments(df: DataFrame, by: str, value: Column) -> DataFrame:
    """Mean, deviation, half width of the 95 % interval, kurtosis (not in excess), range, largest by median, percentiles."""
    v = value.cast("double")
    got = df.groupBy(F.col(by).alias("grp")).agg(
        F.count(v).alias("n"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.stddev_samp(v), 4).alias("sd"),
        F.round(1.96 * F.stddev_samp(v) / F.sqrt(F.count(v).cast("double")), 4).alias("ci95"),
        F.round(F.kurtosis(v) + 3, 4).alias("kurtosis"),
        F.round(F.max(v) - F.min(v), 4).alias("range"),
        F.max(v).alias("_max"),
        F.percentile(v, F.array(*[F.lit(p / 100) for p in PERCENTILES])).alias("_p"),
    )
    named = [F.round(F.col("_p")[i], 6).alias(f"p{p:g}".replace(".", "_")) for i, p in enumerate(PERCENTILES)]
    return got.select("grp", "n", "mean", "sd", "ci95", "kurtosis", "range", F.round(F.col("_max") / (F.col("_p")[PERCENTILES.index(50.0)] + 1e-6), 4).alias("max_by_median"), *named)


def share_of_total(df: DataFrame, by: list[str], within: list[str], value: Column) -> DataFrame:
    """Sums by group with their share of the sum of the outer group, in per cent."""
    sums = df.groupBy(*by).agg(F.round(F.sum(value), 2).alias("amount"))
    whole = sums.groupBy(*within).agg(F.sum("amount").alias("_w"))
    return sums.join(whole, within).select(*by, "amount", F.floor(F.when(F.col("_w") != 0, F.col("amount") * 100 / F.col("_w")).otherwise(0.0) + 0.5).cast("bigint").alias("share_pct"))
