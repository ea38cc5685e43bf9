import random

import pytest
from pyspark.sql import functions as F

from receiptlake.llm import alterations, splits, unionfind
from receiptlake.llm.groups import by_group, salted
from receiptlake.llm.imagenames import original
from receiptlake.operators.ranking import ranked


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("held", [10**6, 40, 5])
def test_components_equal_brute_force_at_any_forest_size(spark, held):
    random.seed(held)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    df = spark.createDataFrame([*edges, (7, None)], "u long, v long").repartition(6)
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items() if k != v}
    assert {r.node: r.component for r in unionfind.components(df, held).collect()} == want


def test_components_of_nothing(spark):
    assert unionfind.components(spark.createDataFrame([], "u string, v string")).count() == 0


MARKS = (frozenset({"copy of", "tampered", "fake", "final", "reupload", "new", "#4"}), frozenset({"tampered", "tampred", "altered", "copy", "edit", "edited", "rot", "q", "gray", "# px", "crop", "thumb"}))


@pytest.mark.parametrize(
    "paths",
    [
        ["dataset/genuine/bill_0000046.jpg", "dataset\\tampered\\bill 0000046 tampered 01.pdf", "x/copy of bill_0000046_tampred_v2_copy.jpg", "bill_0000046%20altered.PNG", "Tampered bill_0000046.jpg"],
        ["Receipt 22-edit2.jpg", "fake_Receipt 22_rot90.png", "Receipt 22 (2).pdf", "RECEIPT 22 - edited.JPG"],
        ["dataset/temp_sroie/image/X51000000799.jpg", "X51O00000799.jpg?v=2", "947b_X51000000799_q95.webp", "final_x51000000799_gray.jpg", "reupload_X51000000799@2x@2x.jpg"],
        ["partner/batch_010/INV-2017-0000689.pdf", "partner\\batch_010\\INV_2017_689_448px.jpg", "INV-2O17-0000689.jpg.jpg"],
        ["dataset/indian/Books/Bill 0001242.jpg", "Bill 1242.tif", "Bill0001242.jpg", "BillOO01242.jpg", "new-Bill 0001242_crop.jpeg"],
        ["uploads/uk/scan-fuel-ponlun-00001095.jpeg", "copy of scan_fuel_ponlun_1095-thumb.jpeg"],
    ],
)
def test_one_original(paths):
    assert len({original(p, *MARKS) for p in paths}) == 1 and original(paths[0])


def test_marks_are_mined_from_names_with_and_without_them(spark):
    rows = [f"d/{w}_{i:05d}{x}.jpg" for i in range(12) for w in ("bill", "shop-karpe-no") for x in ("", "_tmpred", "_tmpred_v2", "_224")]
    rows += [f"d/fake_bill_{i:05d}.jpg" for i in range(5)] + [f"d/IMG-2018010{i}-R{i:06d} tmpred.png" for i in range(9)] + ["odd_bill_00003.jpg", None, "", "x" * 5000]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    before, behind = alterations.mined(df, "path")
    assert before == {"fake"} and behind == {"tmpred", "v", "224"}
    assert alterations.mined(df.limit(0), "path") == (frozenset(), frozenset())


def test_other_originals_and_nothing():
    assert original("IMG-20180118-R000007.jpg", *MARKS) != original("IMG-20180118-R000007_7.jpg", *MARKS)
    assert original("Receipt 3.jpg") != original("Receipt 30.jpg") and original("IMG-20180118-R000017.jpg") != original("IMG-20180118-R000018.jpg")
    assert original(None) is None and original("  ") is None


def test_images_are_grouped_and_split(spark):
    rows = [(i, f"d/bill_{i // 4:07d}{['', '_tampered', '_tampered_v2', ' (2)'][i % 4]}.jpg", ["genuine", "tampered ", "TAMPERED", None][i % 4], i) for i in range(400)]
    rows += [(1000, None, "genuine", 0), (1001, None, "genuine", 0), (1002, "", None, 0), (0, "d/bill_0000000.jpg", "genuine", 0)]
    df = spark.createDataFrame(rows, "manifest_id long, image_path string, label string, grp long")  # grp clashes with what comes out
    g = splits.image_groups(df, "manifest_id", "image_path")
    by = {}
    for r in g.collect():
        by.setdefault(r.grp, set()).add(r.manifest_id)
    assert {1000} in by.values() and {1001} in by.values() and {0, 1, 2, 3} in by.values()
    p = splits.pairs(g, "manifest_id")
    assert p.distinct().count() == 100 * 6
    s = splits.image_splits(df, "manifest_id", "image_path", "label")
    assert s.groupBy("grp").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    share = {r.split: r.n / s.count() for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert share["train"] == pytest.approx(0.8, abs=0.03) and share["val"] == pytest.approx(0.1, abs=0.03)
    assert splits.image_splits(df.limit(0), "manifest_id", "image_path", "label").count() == 0


def test_quotas_equal_the_greedy_one_by_one():
    random.seed(4)
    for _ in range(50):
        sizes = [random.choice([1, 1, 1, 2, 3, 7, 30]) for _ in range(random.randint(1, 300))]
        classes = [("", s, sizes.count(s)) for s in set(sizes)]
        got = {k: 0 for k in splits.TARGETS}
        for _, s, k, a, b in splits.quotas(classes, splits.TARGETS):
            got[k] += s * (b - a + 1)
        assert sum(got.values()) == sum(sizes)
        lack = {k: sum(sizes) * v for k, v in splits.TARGETS.items()}
        for s in sorted(sizes, reverse=True):
            k = max(lack, key=lambda x: lack[x])
            lack[k] -= s
        assert got == pytest.approx({k: sum(sizes) * v - lack[k] for k, v in splits.TARGETS.items()})


def test_ranks_are_whole_within_classes(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2 + F.when(F.col("id") < 4000, 0).otherwise(5)).alias("c"))
    r = ranked(df, ["c"], "id", 5000, bucket_rows=100)
    for x in r.groupBy("c").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.countDistinct("rank").alias("d")).collect():
        assert (x.a, x.b, x.d) == (1, x.n, x.n)


def test_large_groups_are_cut_and_small_ones_not(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 10)).alias("key"), "id")
    s = salted(df, "key", 100)
    assert s.where("key <> 'hot'").agg(F.max("part")).first()[0] == 0 and s.where("key = 'hot'").select("part").distinct().count() == 9 and s.count() == 1000
    n = by_group(s, ["key", "part"], ["id"], lambda rows: [(len(rows),)], "n int").agg(F.sum("n")).first()[0]
    assert n == 1000
