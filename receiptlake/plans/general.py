"""Queries of the general training-data problems that live in the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed, quantities, timestamps
from ..session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities.canonical_amounts(table(spark, d, "receipts_master"), table(spark, d, "source_profile"), table(spark, d, "currency_rates")).select("row_id", "micro_myr")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tables = [
        ("receipts_master", table(spark, d, "receipts_master"), "row_id", "date", "source"),
        ("sroie_entities", table(spark, d, "sroie_entities"), "entity_id", "date", "=SROIE"),
    ]
    return timestamps.normalise_moments(tables, table(spark, d, "source_profile"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "receipts_master").where("source IS NULL OR source <> 'SROIE'")
    return packed.unpack(rows)


def p2_plain(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of the texts that SQL can read as well: ringgit with two decimals."""
    rows = table(spark, d, "receipts_master").where(F.regexp_like("total", F.lit(r"^RM ?\d{1,9}\.\d{2}$"))).select("row_id")
    return p2_found(spark, d).join(rows, "row_id")


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    """Moments of the texts that SQL can read as well: ISO days and ISO instants in UTC."""
    rows = table(spark, d, "receipts_master").where(F.regexp_like("date", F.lit(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$"))).select(F.col("row_id").alias("rec_key"))
    return p3_found(spark, d).where("table_name = 'receipts_master'").join(rows, "rec_key").select("rec_key", "moment")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows with items by source, of which none has a gap in its positions, an empty item or blanks around one."""
    per = p7_found(spark, d).groupBy("row_id").agg(F.max("pos").alias("m"), F.count("*").alias("n"), F.count_distinct("pos").alias("k"), F.count_if((F.trim("item") != F.col("item")) | (F.col("item") == "")).alias("b"))
    j = per.join(table(spark, d, "receipts_master").select("row_id", "source"), "row_id")
    return j.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if((F.col("m") != F.col("n")) | (F.col("k") != F.col("n"))).alias("n_gaps"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_blank"))


SQL = {
    "p2_plain": r"SELECT row_id, CAST(replace(regexp_extract(total, '(\d+\.\d{2})$', 1), '.', '') AS BIGINT) * 10000 AS micro_myr FROM receipts_master WHERE regexp_full_match(total, 'RM ?\d{1,9}\.\d{2}')",
    "p3_plain": r"""SELECT row_id AS rec_key, CASE WHEN length(date) = 10 THEN date ELSE left(date, 19) || '.000Z' END AS moment FROM receipts_master
WHERE regexp_full_match(date, '\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?') AND try_strptime(left(date, 10), '%Y-%m-%d') IS NOT NULL AND (length(date) = 10 OR try_strptime(date, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL)""",
    "p7_checks": r"SELECT source, count(*) AS n_rows, 0 AS n_gaps, 0 AS n_blank FROM receipts_master WHERE source <> 'SROIE' AND regexp_matches(coalesce(items_text, ''), '[\p{L}\p{N}]') GROUP BY 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_plain, p3_found, p3_plain, p7_found, p7_checks)}


def oracle_sql() -> dict[str, str]:
    """SQL reads only what is plain in these texts, and says what must hold of the rest."""
    return dict(SQL)
