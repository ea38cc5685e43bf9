"""Amounts recorded in different currencies, units and scales, brought to one unit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units


def parse_amount(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, cur in parts:
        got = [(a[0], *units.decimal_parts(a[1])) if (a := units.amount(t, c)) else (None, None, 0) for t, c in zip(text, cur)]
        yield pd.DataFrame(got, columns=["currency", "digits", "decimals"])


def parse_measure(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, unit in parts:
        got = [units.measure(t, u or "") if t else None for t, u in zip(text, unit)]
        yield pd.DataFrame({"value": [None if g is None else float(g[0]) for g in got], "dimension": [None if g is None else " ".join(f"{b}^{e}" for b, e in g[1]) for g in got]})


def canonical_measures(df: DataFrame, key: str, text: str, unit: str | Column) -> DataFrame:
    """(key, value, dimension) of each row of df whose text is a measure of physical units; ``unit`` holds where the text
    names none. Nulls, empty texts and unknown units give no row."""
    u = F.lit(unit) if isinstance(unit, str) else unit
    got = df.select(F.col(key), F.col(text).alias("_t"), u.alias("_u")).where(F.length("_t") > 0)
    return got.select(key, F.pandas_udf(parse_measure, "value double, dimension string")("_t", "_u").alias("_p")).select(key, "_p.value", "_p.dimension").where("value IS NOT NULL")


def canonical_amounts(df: DataFrame, profile: DataFrame, rates: DataFrame, key: str = "row_id", text: str = "total", source: str = "source") -> DataFrame:
    """(key, micro_myr) of each row whose text can be read as one amount.

    The plan has no shuffle: profile and rates are dimension tables (one row a source, one a currency), which Catalyst
    broadcasts while their size on disk is below its threshold and else shuffles. Null, empty and unreadable texts, and
    currencies without a rate, give no row. Products are made in 38 digits and what is below a millionth is cut off; an
    amount that the bigint of the result can't hold gives no row. Repeated rows give a row each; a source without a profile
    is read only if its text names a currency.
    """
    rows = df.select(F.col(key).alias("_k"), F.trim(F.col(text)).alias("_t"), F.col(source).alias("_s")).where("length(_t) > 0 AND _t RLIKE '[0-9]'")
    prof = profile.select(F.col("source").alias("_ps"), F.col("currency").alias("_pc")).where("_ps IS NOT NULL").dropDuplicates(["_ps"])
    rate = rates.select(F.col("currency").alias("_rc"), F.col("micro_myr_per_unit").alias("_rate")).where("_rc IS NOT NULL AND _rate IS NOT NULL").dropDuplicates(["_rc"])
    read = rows.join(prof, F.col("_s") == F.col("_ps"), "left").select("_k", F.pandas_udf(parse_amount, "currency string, digits string, decimals int")("_t", "_pc").alias("_p")).select("_k", "_p.currency", "_p.digits", "_p.decimals").where("digits IS NOT NULL")
    product = F.expr("try_multiply(TRY_CAST(digits AS DECIMAL(38,0)), CAST(_rate AS DECIMAL(20,0)))")
    unit = F.expr("CAST(rpad('1', decimals + 7, '0') AS DECIMAL(38,0))")
    got = read.join(rate, F.col("currency") == F.col("_rc")).select("_k", product.alias("_p"), unit.alias("_u"))
    whole = F.expr("TRY_CAST((_p - pmod(_p, _u)) / _u AS BIGINT)")
    return got.select(F.col("_k").alias(key), whole.alias("micro_myr")).where("micro_myr IS NOT NULL")
