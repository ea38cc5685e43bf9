"""Amounts as the sources record them, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired_total(raw: Column, source: Column) -> Column:
    """The last number of a text: for CORD every mark divides groups, elsewhere commas do; null if there is none."""
    token = F.rtrim(F.try_element_at(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"(\d[\d.,]*)"), F.lit(1)), F.lit(-1)), F.lit(".,"))
    return F.when(source == "CORD", F.regexp_replace(token, "[.,]", "").try_cast("double")).otherwise(F.regexp_replace(token, ",", "").try_cast("double"))


def legacy_total(raw: Column) -> Column:
    """The older reading: commas dropped, of several points the last is decimal, two decimals; empty if unreadable."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9.,]", ""), ",", "")
    parts = F.split(kept, r"\.")
    n = F.size(parts)
    joined = F.when(n > 2, F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ""), F.lit("."), F.element_at(parts, -1))).otherwise(kept)
    return F.coalesce(joined.try_cast("decimal(18,2)").cast("string"), F.lit(""))


def plain_number(raw: Column) -> Column:
    return F.trim(raw).try_cast("double")


def normal_total(raw: Column) -> Column:
    """Two decimals, halves to even; 0.00 for what isn't a number."""
    return F.bround(F.coalesce(F.trim(raw).try_cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)")), 2).cast("decimal(18,2)")


def cleaned_currency(raw: Column) -> Column:
    """The number a text starts with once currency signs, commas and blanks are gone; 0 if it starts with none."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)rs\.?|inr", ""), r"[₹$€£,\s]", "")
    return F.coalesce(F.regexp_extract(bare, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double"), F.lit(0.0))


def half_up(x: Column) -> Column:
    """Rounded to whole, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))
