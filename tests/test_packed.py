import pytest

from receiptlake.functions import packed as p
from receiptlake.operators import packed

DEFAULT = ("separator", "lines", "tab", "double bar", "bar", "semicolon", "wide comma", "plus", "slash", "comma")
CASES = [
    ("Sate Sapi x6; Roti;Flat White (4)", ["Sate Sapi x6", "Roti", "Flat White (4)"]), ("Garden Hose (4) 1,5L", ["Garden Hose (4) 1,5L"]), ("Roti x5,8x Teh", ["Roti x5", "8x Teh"]), ('"Soup, hot", Tea', ["Soup, hot", "Tea"]), ('"Soup, ""house"" style"', ['Soup, "house" style']),
    ("'Rice; no lid'; 'Tea'", ["Rice; no lid", "Tea"]), ('["Tea \\"fresh\\"", "Veg, less salt"]', ['Tea "fresh"', "Veg, less salt"]), ("Soup\\, takeaway, Tea", ["Soup, takeaway", "Tea"]), ("Rice (3, no ice), Tea", ["Rice (3, no ice)", "Tea"]),
    ("1) Rice 2) Tea (2) 3) Soup", ["Rice", "Tea (2)", "Soup"]), ("• Rice • Tea", ["Rice", "Tea"]), ("* Rice\n* Tea", ["Rice", "Tea"]), ("|Rice||Tea|", ["Rice", "Tea"]), ("Rice / Tea + Soup\tBread", ["Rice", "Tea", "Soup", "Bread"]), ("Rice\\nTea", ["Rice", "Tea"]), ("Rice、Tea，Soup", ["Rice", "Tea", "Soup"]),
    ("Rice w/ Egg & Cheese @ 12.000", ["Rice w/ Egg & Cheese @ 12.000"]), (";;", []), ("", []), (None, []),
]


@pytest.mark.parametrize(("text", "wanted"), CASES)
def test_items(text, wanted):
    assert p.items(text, DEFAULT) == wanted


def test_delimiters_are_inferred_and_positions_kept(spark):
    rows = [(i, f"{a}; {b}; {a} w/ Egg & Cheese", "S", 0) for i, (a, b) in enumerate([("Red Tea", "Fried Rice"), ("Fried Rice", "Red Tea"), ("Red Tea", "Red Tea")])]
    rows += [(9, None, "S", 0), (10, " ; ", "S", 0), (11, "Plain Bun", None, 0), (0, "Red Tea; Fried Rice; Red Tea w/ Egg & Cheese", "S", 0), (12, "Red Tea; " * 5000, "S", 0)]
    df = spark.createDataFrame(rows, "row_id long, items_text string, source string, pos int")  # pos clashes with what comes out
    names = {r[0]: r[1] for r in packed.delimiters(df, "items_text", "source").collect()}
    assert names == {"S": ["semicolon"]}
    got = sorted(tuple(r) for r in packed.unpack(df).collect())
    assert [r for r in got if r[0] == 1] == [(1, 1, "Fried Rice"), (1, 2, "Red Tea"), (1, 3, "Fried Rice w/ Egg & Cheese")]
    assert sum(r[0] == 0 for r in got) == 6 and sum(r[0] == 12 for r in got) == 5000 and (11, 1, "Plain Bun") in got
    assert not [r for r in got if r[0] in (9, 10)]
    assert packed.unpack(df.limit(0)).count() == 0


def test_the_same_mark_parts_values_in_one_source_and_not_in_another(spark):
    foods = ["Red Tea", "Fried Rice", "Plain Bun", "Corn Soup", "Flat Bread", "Iced Milk"]
    rows = []
    for i in range(60):
        some = [foods[(i + j) % 6] for j in range(2 + i % 4)]
        rows.append((i, ", ".join(some), "commas"))
        rows.append((100 + i, "; ".join(f"{x}, {['no lid', 'extra hot', 'to go'][i % 3]}" for x in some), "notes"))
    df = spark.createDataFrame(rows, "row_id long, items_text string, source string")
    assert {r.source: r.names for r in packed.delimiters(df, "items_text", "source").collect()} == {"commas": ["comma"], "notes": ["semicolon"]}
    got = packed.unpack(df)
    assert got.where("row_id = 1").count() == 3 and [r.item for r in got.where("row_id = 101").orderBy("pos").collect()] == ["Fried Rice, extra hot", "Plain Bun, extra hot", "Corn Soup, extra hot"]


def test_piece_counts_tell_delimiters_from_marks_inside_values():
    lists = {2: 40, 3: 25, 4: 15, 5: 10, 6: 6, 7: 4}
    got = packed.agreement({"bar": lists, "slash": {k: n // 2 for k, n in lists.items()}, "amp": {2: 92, 3: 8}}, {"bar": 1.0, "slash": 1.0, "amp": 0.4})
    assert got["bar"] > 0.9 and got["slash"] > 0.9 and got["amp"] < 0.75
    rows = packed.agreement({"bar": {2: 9000, 5: 1000}, "once": {9: 1}}, {"bar": 1.0, "once": 1.0})
    assert rows["once"] == 1.0  # one text tells nothing


def test_a_rare_mark_of_a_source_is_judged_by_all(spark):
    foods = ["Red Tea", "Fried Rice", "Plain Bun", "Corn Soup"]
    rows = [(i, " | ".join(foods[(i + j) % 4] for j in range(2 + i % 3)), "many") for i in range(80)] + [(900, "Green Apples | Blue Pen", "few"), (901, "Dish Soap", "few")]
    df = spark.createDataFrame(rows, "row_id long, items_text string, source string")
    assert [r.item for r in packed.unpack(df).where("row_id = 900").orderBy("pos").collect()] == ["Green Apples", "Blue Pen"]
