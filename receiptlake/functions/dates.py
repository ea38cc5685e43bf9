"""The day formats of the source systems, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three letters that name a month.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))


def receipt_day(raw: Column) -> Column:
    """``YYYY-MM-DD`` from ISO, day/month/year with two or four digits (above 50 is 19xx) and named months; else null.

    Numbers aren't held against the calendar: 31/02/2018 stays as it is written.
    """
    t = F.trim(raw)
    g = lambda p, i: F.regexp_extract(t, p, i)
    four, two = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})$"
    dmy, mdy = r"^(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})$", r"^([A-Za-z]{3,})\s+(\d{1,2}),?\s+(\d{4})$"
    is_ = lambda p: F.regexp_like(t, F.lit(p))
    yy = g(two, 3).try_cast("int")
    return (
        F.when(is_(r"^\d{4}-\d{2}-\d{2}$"), t)
        .when(is_(four), _iso(g(four, 3), g(four, 2), g(four, 1)))
        .when(is_(two), _iso(F.when(yy > 50, 1900 + yy).otherwise(2000 + yy), g(two, 2), g(two, 1)))
        .when(is_(dmy) & (_month(g(dmy, 2)) > 0), _iso(g(dmy, 3), _month(g(dmy, 2)), g(dmy, 1)))
        .when(is_(mdy) & (_month(g(mdy, 1)) > 0), _iso(g(mdy, 3), _month(g(mdy, 1)), g(mdy, 2)))
    )


def strict_day(raw: Column) -> Column:
    """A real date in one of six formats tried in turn, two-digit years above 68 are 19xx; else null."""
    t = F.trim(raw)
    short = F.try_to_timestamp(t, F.lit("d/M/yy"))
    fixed = F.when(F.year(short) > 2068, F.add_months(short.cast("date"), F.lit(-1200))).otherwise(short.cast("date"))
    is_ = lambda p: F.regexp_like(t, F.lit(p))
    tried = lambda f: F.try_to_timestamp(t, F.lit(f)).cast("date")
    return (
        F.when(is_(r"^\d{1,2}/\d{1,2}/\d{4}$"), tried("d/M/yyyy"))
        .when(is_(r"^\d{1,2}-\d{1,2}-\d{4}$"), tried("d-M-yyyy"))
        .when(is_(r"^\d{4}-\d{1,2}-\d{1,2}$"), tried("yyyy-M-d"))
        .when(is_(r"^\d{1,2}/\d{1,2}/\d{2}$"), fixed)
        .when(is_(r"(?i)^\d{1,2} [a-z]{3} \d{4}$"), tried("d MMM yyyy"))
        .when(is_(r"(?i)^\d{1,2} [a-z]{4,} \d{4}$"), tried("d MMMM yyyy"))
    )


def day_parts(day: Column) -> tuple[Column, Column]:
    """(day of month, weekday with Monday as 0); 1 and 0 for null."""
    return F.coalesce(F.dayofmonth(day), F.lit(1)), F.coalesce(F.weekday(day), F.lit(0))


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis_or_zero(iso: Column) -> Column:
    """Milliseconds since 1970 of an ISO text, 0 if it can't be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(iso)), F.lit(0))


def now_iso() -> Column:
    """The time of the run in UTC as ISO text; the same for all rows."""
    return iso_instant(F.current_timestamp())
