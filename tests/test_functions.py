import pytest
from pyspark.sql import functions as F

from receiptlake.functions import dates, hashing, money, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "source", "wanted"), [("48.000", "CORD", 48000.0), ("TOTAL 47,499", "CORD", 47499.0), ("RM4.00", "SROIE", 4.0), ("1,234.50", "SROIE", 1234.5), ("", "SROIE", None), ("abc", "CORD", None), ("-9.90", "SROIE", 9.9), ("1.2.3", "SROIE", None)])
def test_repaired_total(spark, raw, source, wanted):
    assert one(spark, money.repaired_total(F.col("r"), F.col("s")), r=raw, s=source) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [("1,591,600", "1591600.00"), ("RM 9.00", "9.00"), ("1.591.600", "1591.60"), ("48.000", "48.00"), ("", "")])
def test_legacy_total(spark, raw, wanted):
    assert one(spark, money.legacy_total(F.col("r")), r=raw) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [("9", "9.00"), ("2.345", "2.34"), ("2.355", "2.36"), ("x", "0.00")])
def test_normal_total(spark, raw, wanted):
    assert str(one(spark, money.normal_total(F.col("r")), r=raw)) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [("₹1,299.50", 1299.5), ("Rs. 450", 450.0), ("INR 20", 20.0), ("12abc", 12.0), ("abc", 0.0)])
def test_cleaned_currency(spark, raw, wanted):
    assert one(spark, money.cleaned_currency(F.col("r")), r=raw) == wanted


@pytest.mark.parametrize(
    ("raw", "loose", "strict"),
    [("2026-04-15", "2026-04-15", "2026-04-15"), ("5-3-2018", "2018-03-05", "2018-03-05"), ("25/12/18", "2018-12-25", "2018-12-25"), ("25-12-18", "2018-12-25", None), ("01/02/60", "1960-02-01", "2060-02-01"), ("15 Apr 2026", "2026-04-15", "2026-04-15"), ("Apr 15, 2026", "2026-04-15", None), ("31/02/2018", "2018-02-31", None), ("", None, None)],
)
def test_days(spark, raw, loose, strict):
    assert one(spark, dates.receipt_day(F.col("r")), r=raw) == loose
    assert one(spark, dates.strict_day(F.col("r")).cast("string"), r=raw) == strict


@pytest.mark.parametrize(("a", "b", "wanted"), [("YOUSTA", "yousta.", 1.0), ("A & B", "A and B", 1.0), ("abc", "", 0.0), ("dmart store", "store dmart", 1.0)])
def test_name_similarity(spark, a, b, wanted):
    assert one(spark, text.name_similarity(text.merchant_key(F.col("a")), text.merchant_key(F.col("b"))), a=a, b=b) == wanted


@pytest.mark.parametrize(("t", "wanted"), [("Steak House", "Food & Beverage"), ("Price Mart", "Food & Beverage"), ("ABC Mini Market", "Supermarket / Grocery"), ("Hardware", "General Retail")])
def test_spend_class(spark, t, wanted):
    assert one(spark, text.spend_class(F.col("t")), t=t) == wanted


def test_texts(spark):
    assert one(spark, text.receipt_group(F.col("p")), p="dataset/tampered/Receipt 10_tampered_v2.jpg") == "receipt 10"
    assert one(spark, text.without_fence(F.col("p")), p="```json\n{}\n```") == "{}"
    assert one(spark, text.document_id(F.col("p")), p="小店").startswith("m_")
    assert [one(spark, text.sentence_list(F.array(*map(F.lit, xs)))) for xs in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a and b", "a, b and c"]
    assert one(spark, text.words_share(F.col("p"), ["total", "cash"]), p="TOTAL cash 12 foo") == pytest.approx(2 / 3)


def test_hash_bands_miss_nothing(spark):
    import random

    random.seed(1)
    a = [random.getrandbits(63) for _ in range(60)]
    b = [x ^ sum(1 << i for i in random.sample(range(63), random.randint(0, 9))) for x in a]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(a + b)], "k long, h long")
    from receiptlake.operators.dedup import hash_pairs

    got = {(r.a, r.b) for r in hash_pairs(df, "k", F.col("h"), 6).collect()}
    hs = a + b
    assert got == {(i, j) for i in range(len(hs)) for j in range(i + 1, len(hs)) if bin(hs[i] ^ hs[j]).count("1") <= 6}
    assert one(spark, hashing.from_hex(F.col("x")), x="ffffffffffffffff") == -1 and one(spark, hashing.from_hex(F.col("x")), x="zz") is None
