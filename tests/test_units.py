from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from receiptlake.functions import units
from receiptlake.operators import quantities

CASES = [
    ("RM4.00", "MYR", ("MYR", 4_000_000)), ("48.000", "IDR", ("IDR", 48_000_000_000)), ("1,591,600", "IDR", ("IDR", 1_591_600_000_000)), ("30.262,00", "IDR", ("IDR", 30_262_000_000)),
    ("₹2,80,123", "INR", ("INR", 280_123_000_000)), ("Rs. 535,35", "INR", ("INR", 535_350_000)), ("12.3.4", "MYR", None), ("RM", "MYR", None), ("see bill", "MYR", None), ("N/A", "MYR", None),
    ("59 pounds 81 pence", "GBP", ("GBP", 59_810_000)), ("9 Australian dollars 5 cents", "SGD", ("AUD", 9_050_000)), ("amount in sen: 3044", "MYR", ("MYR", 30_440_000)), ("18,501 paisa", "INR", ("INR", 185_010_000)),
    ("RM 0.1 thousand", "MYR", ("MYR", 100_000_000)), ("Rp 0,1 juta", "IDR", ("IDR", 100_000_000_000)), ("78 (x1000)", "IDR", ("IDR", 78_000_000_000)), ("28 (dalam ribuan rupiah)", "IDR", ("IDR", 28_000_000_000)), ("GBP 1 ('000)", "GBP", ("GBP", 1_000_000_000)),
    ("$7.50", "AUD", ("AUD", 7_500_000)), ("US$7.50", "AUD", ("USD", 7_500_000)), ("MYR 14.-", "MYR", ("MYR", 14_000_000)), ("GBP 17/=", "GBP", ("GBP", 17_000_000)), ("Rs 16.4 lakh", "INR", ("INR", 1_640_000_000_000)),
    ("990 p", "GBP", ("GBP", 9_900_000)), ("990 p", "INR", ("GBP", 9_900_000)), ("12.50 13.20", "MYR", None), ("RM 5 USD", "MYR", None), ("5", None, None), ("", "MYR", None), (None, "MYR", None), ("-9.90", "MYR", ("MYR", -9_900_000)),
]


@pytest.mark.parametrize(("text", "currency", "wanted"), CASES)
def test_amounts(text, currency, wanted):
    assert units.amount(text, currency) == wanted


@given(st.integers(0, 10**9), st.sampled_from(["{:,}.{:02d}", "{}.{:02d}"]))
def test_any_amount_comes_back(cents, form):
    assert units.amount("RM " + form.format(cents // 100, cents % 100), "MYR") == ("MYR", cents * 10_000)


def test_measures_have_dimensions():
    assert units.measure("36 km/h") == (Fraction(10), (("length", 1), ("time", -1)))
    assert units.measure("20 °C")[0] == Fraction("293.15")
    assert units.measure("3 kg m^2 s^-2") == units.measure("3 J")
    assert units.measure("5", "lb")[1] == (("mass", 1),)
    assert units.measure("5 furlongs") is None and units.measure("°C m") is None


def test_operator_has_a_row_for_each_readable_row(spark):
    rows = [(1, "RM 2", "S", "x"), (1, "RM 2", "S", "x"), (2, None, "S", "x"), (3, "", "S", "x"), (4, "7 EUR", "S", "x"), (5, "9", None, "x"), (6, "USD 9", None, "x"), (7, "1" * 40, "S", "x"), (8, "Rp 5,000,000,000,000", "S", "x"), (9, "RM 1.2345678", "S", "x"), (10, "IDR 90,000,000,000,000,000", "S", "x"), (11, "-RM 1.2345675", "S", "x")]
    df = spark.createDataFrame(rows, "row_id long, total string, source string, currency string")  # a column with a name that the profile has too
    prof = spark.createDataFrame([("S", "UTC", "dmy", "MYR"), ("S", "UTC", "dmy", "MYR"), (None, "UTC", "dmy", "MYR")], "source string, tz_name string, date_order string, currency string")
    rates = spark.createDataFrame([("MYR", 1_000_000), ("USD", 4_400_000), ("IDR", 290)], "currency string, micro_myr_per_unit long")
    got = sorted(tuple(r) for r in quantities.canonical_amounts(df, prof, rates).collect())
    assert got == [(1, 2_000_000), (1, 2_000_000), (6, 39_600_000), (8, 1_450_000_000_000_000), (9, 1_234_567), (11, -1_234_568)]
    assert quantities.canonical_amounts(df.limit(0), prof, rates).count() == 0


def test_measures_of_a_table(spark):
    df = spark.createDataFrame([(1, "2 km"), (2, "5"), (3, None), (4, "x")], "k long, t string")
    assert {tuple(r) for r in quantities.canonical_measures(df, "k", "t", "cm").collect()} == {(1, 2000.0, "length^1"), (2, 0.05, "length^1")}
