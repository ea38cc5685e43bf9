import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from receiptlake import session
from receiptlake.functions import images
from receiptlake.operators import dedup, evaluation, forest, learning, profiling, sampling, windows
from receiptlake.sources import readers, writers


def test_fuzzy_pairs_equal_all_pairs_of_a_block(spark):
    random.seed(2)
    rows = [(i, "u", round(random.uniform(0, 20), 2), random.choice(["abc shop", "abc shops", "zed"])) for i in range(80)] + [(90, "u", None, "abc shop"), (91, None, 1.0, "abc shop")]
    df = spark.createDataFrame(rows, "k long, u string, v double, m string")
    from receiptlake.functions import text

    got = {(r.a, r.b) for r in dedup.fuzzy_pairs(df, "k", ["u"], "v", F.col("m"), text.name_similarity).collect()}
    near = lambda a, b: abs(a[2] - b[2]) <= 2 and "zed" not in {a[3], b[3]} or abs(a[2] - b[2]) <= 2 and a[3] == b[3]
    want = {(a[0], b[0]) for a in rows[:80] for b in rows[:80] if a[0] < b[0] and near(a, b)}
    assert got == want


def test_trailing_median_and_decay_equal_the_fold(spark):
    random.seed(3)
    rows = [(i, f"u{i % 3}", random.choice("ab"), round(random.uniform(-5, 50), 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, u string, c string, v double")
    got = {r.k: (r.n_before, r.reference) for r in windows.trailing_median(df, "u", ["k"], "v").collect()}
    past, weights = {}, {}
    for k, u, c, v in rows:
        if v > 0:
            p = sorted(past.setdefault(u, [])[-50:])
            assert got[k] == (len(p), pytest.approx(2748.0 if len(p) < 5 else float(np.median(p))))
            past[u].append(v)
        w = weights.setdefault(u, {})
        for x in w:
            w[x] *= 0.98
        w[c] = w.get(c, 0) + math.log1p(max(v, 0))
    for r in windows.decayed_interest(df, "u", "c", [F.col("k")], "v").collect():
        assert r.weight == pytest.approx(weights[r.u][r.category], abs=1e-4)


def test_auc_and_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (0, None)], "y int, s double")
    assert evaluation.roc_auc(df, "y", "s").first().auc == 0.875
    assert evaluation.best_threshold(evaluation.roc_points(df.where("s IS NOT NULL"), "y", "s")).first().score == 0.9  # 0.5 is as far above the diagonal; the higher wins
    assert evaluation.roc_auc(df.where("y = 1"), "y", "s").first().auc is None


def test_ranking_is_perfect_for_an_ideal_order(spark):
    df = spark.createDataFrame([("u", 3.0, 3.0), ("u", 2.0, 1.0), ("u", 1.0, 0.0)], "u string, s double, g double")
    r = evaluation.ranking(df, "u", [F.desc("s")], "g", 2, 1.0).first()
    assert (r.precision, r.recall, r.ndcg) == (1.0, 1.0, 1.0)


def test_groups_stay_in_one_fold(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}") for i in range(100)], "k long, g string")
    f = sampling.group_folds(df, F.col("g"), 3)
    assert sampling.leaks(f, "grp", "fold").isEmpty()
    s = sampling.stratified(df, "k", "g", [("train", 0.7), ("test", 0.3)]).groupBy("stratum", "split").count().collect()
    assert {(r.stratum, r.split): r["count"] for r in s}["g0", "train"] == int(15 * 0.7)


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert {r.column_name: r.n_missing for r in profiling.missing_rates(df, ["a", "b"]).collect()} == {"a": 0, "b": 0}
    assert tuple(profiling.repeats(df, ["a", "b"]).first()) == (0, 0, 0)


def test_isolation_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x)) for i, x in enumerate(rng.normal(0, 1, 600))] + [(999, 40.0), (1000, None)]
    df = spark.createDataFrame(rows, "k long, x double")
    top = learning.isolation_scores(df, "k", ["x"], learning.isolation_forest(df, ["x"], trees=50)).orderBy(F.desc("score")).first()
    assert top.k == 999 and top.score > 0.6


def test_classifier_beats_the_commonest_class_on_held_out_rows(spark):
    random.seed(5)
    words = {"food": ["rice", "tea", "soup", "egg"], "shop": ["pen", "hose", "paper", "socks"]}
    rows = [(i, " ".join(random.choices(words[c], k=4) + random.choices(["big", "red", "small"], k=2)), c) for i, c in enumerate(random.choices(["food", "shop"], k=240))]
    df = spark.createDataFrame(rows, "k long, t string, c string")
    train, test = df.where("k % 4 <> 0"), df.where("k % 4 = 0")
    for kind in ("lr", "rf"):
        got = learning.classified(learning.classifier(train, "t", "c", kind, trees=10), test, "k").join(test, "k")
        assert got.agg(F.avg((F.col("predicted") == F.col("c")).cast("double"))).first()[0] > 0.9


def test_models_are_told_apart_over_features_made_once(spark, monkeypatch):
    made, features = [], learning.text_features
    monkeypatch.setattr(learning, "text_features", lambda text: made.append(text) or features(text))
    random.seed(7)
    words = {"food": ["rice", "tea", "soup", "egg"], "shop": ["pen", "hose", "paper", "socks"], "fuel": ["pump", "litre", "ron", "diesel"]}
    rows = [(i, " ".join(random.choices(words[c], k=4) + ["big"]), c) for i, c in enumerate(random.choices(sorted(words), k=300))]
    df = spark.createDataFrame(rows, "k long, t string, c string")
    kind, model, scores = learning.selected(df.where("k % 3 <> 0"), df.where("k % 3 = 0"), "t", "c", "k", trees=10)
    assert made == ["t"] and {k for k, _ in scores} == {"lr", "svc", "rf"} and all(f > 0.9 for _, f in scores)
    got = learning.classified(model, df.where("k % 3 = 0"), "k").join(df, "k")
    assert kind == scores[0][0] and got.agg(F.avg((F.col("predicted") == F.col("c")).cast("double"))).first()[0] > 0.9


def test_forest_over_more_features_than_rows_could_hold(spark):
    rng, size = np.random.default_rng(3), 20_000
    rows = []
    for i in range(1500):
        held = {int(x): float(v) for x, v in zip(rng.integers(3, size, 20), rng.uniform(0.05, 0.3, 20))}
        rows.append((float(i % 3), Vectors.sparse(size, {**held, **({0: 0.5} if i % 3 == 1 else {0: 0.9} if i % 3 == 2 else {})})))
    table = session.cut(spark.createDataFrame(rows, ["_y", "features"]))
    model = forest.forest(table, "_y", size, [1.0, 1.0, 2.0], trees=1, depth=4)
    assert model.transform(table).where("prediction <> _y").count() == 0 and (model.numFeatures, model.numClasses) == (size, 3)
    many = forest.forest(table, "_y", size, [1.0, 1.0, 1.0], trees=7, depth=5)
    saved = f"{session.run_dir(spark)}/a-forest"
    many.save(saved)
    n = {(r.treeID, r.nodeData.id): r.nodeData for r in spark.read.parquet(f"{saved}/data").collect()}
    inner = [(t, x) for (t, _), x in n.items() if x.leftChild >= 0]
    assert len({t for t, _ in n}) == 7 and len(inner) > 7 and max(t.depth for t in many.trees) <= 5
    for t, x in inner:
        sides = [n[t, x.leftChild], n[t, x.rightChild]]
        assert x.gain > 0 and all(s.rawCount > 0 for s in sides) and x.impurityStats == [sum(v) for v in zip(*(s.impurityStats for s in sides))]
    assert all(1300 < n[t, 0].rawCount < 1700 for t in range(7))


def test_factor_model_and_unknown_sides(spark):
    random.seed(6)
    rows = [(u, i, float(min(5, max(1, 3 + (u % 3 - 1) + (i % 2))))) for u in range(30) for i in range(12) if random.random() < 0.7]
    df = spark.createDataFrame(rows, "u int, i int, r double")
    model = learning.biased_factors(df, "u", "i", "r")
    est = learning.estimate(df, "u", "i", model)
    assert est.agg(F.avg(F.abs(F.col("estimate") - F.col("r")))).first()[0] < 0.5
    odd = {tuple(r)[:2]: r.estimate for r in learning.estimate(spark.createDataFrame([(99, 1), (99, 99)], "u int, i int"), "u", "i", model).collect()}
    assert odd[99, 99] is None and 1 <= odd[99, 1] <= 5


def test_files_round_trip(spark, tmp_path):
    for name, body in {"a.txt": {"company": "X", "date": "1", "address": "A", "total": "2"}, "b.txt": {"date": "3"}}.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "c.txt").write_text("no json {")
    got = {r.image_path.rsplit("/", 1)[-1]: (r.merchant, r.total) for r in readers.entity_files(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": ("X", "2"), "b.jpg": ("UNKNOWN", "")}
    df = spark.createDataFrame([("a,b", 'say "x"\nnow'), (None, " y ")], "p string, q string")
    path = writers.csv_out(df, str(tmp_path / "out"), ["p", "q"])
    assert {tuple(r) for r in readers.csv_strings(spark, path, ["p", "q"]).collect()} == {("a,b", 'say "x"\nnow'), (None, " y ")}
    assert readers.csv_strings(spark, str(tmp_path / "none.csv"), ["p"]).count() == 0
    assert readers.listing(spark, str(tmp_path), "*.txt").count() == 3


def test_image_features(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 255, (96, 96)).astype(np.uint8)
    dup = g.copy()
    dup[64:80, 64:80] = g[8:24, 8:24]
    flat = np.full((40, 40), 200, np.uint8)
    f = {k: dict(images.copied_blocks(a.astype(float))) for k, a in {"plain": g, "dup": dup, "flat": flat}.items()}
    assert f["dup"]["copy_best"] > 0.99 > f["plain"]["copy_best"] and f["flat"]["copy_share"] == 0
    one, two = images.sharpness_of([flat.astype(float), g.astype(float)])
    assert one == 0.0 and two > 100
    band = flat.copy()
    band[4:8] = 0
    assert images.dense_band(band.astype(float)) == (True, 1.0)
    a, b = images.perceptual_hash(g.astype(float)), images.perceptual_hash(np.clip(g.astype(float) + 3, 0, 255))
    assert bin(int(a, 16) ^ int(b, 16)).count("1") <= 6
    df = spark.createDataFrame([("p", 96, 96, 1, bytearray(g.tobytes())), ("bad", 5, 5, 3, bytearray(b"x"))], "path string, width int, height int, channels int, pixels binary")
    got = {r.path: r for r in images.features(df).collect()}
    assert got["bad"].features is None and len(got["p"].features) > 25
    ways = {r.way: bytes(r.pixels) for r in images.altered(df.where("path = 'p'")).collect()}
    assert sorted(ways) == sorted(images.WAYS) and len(set(ways.values()) | {g.tobytes()}) == 5


def test_running_totals_over_ranges(spark):
    random.seed(7)
    rows = [(g, i, random.randint(0, 9)) for g in ("a", None, "c") for i in random.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    for by in (["g"], []):
        ordered = sorted({(r[0] if by else "", r[1], r[2]) for r in rows}, key=lambda r: (str(r[0]), r[1]))
        one = df if by else df.where("g = 'a'")
        want, sums = {}, {}
        for g, k, v in ordered if by else sorted((r for r in rows if r[0] == "a"), key=lambda r: r[1]):
            key = g if by else ""
            sums[key] = sums.get(key, 0) + v
            want[g, k] = sums[key]
        assert {(r.g, r.k): r.s for r in windows.running_total(one, by, "k", "v", "s").collect()} == want
    assert windows.running_total(df.limit(0), [], "k", "v", "s").count() == 0


def test_boosted_trees_and_what_they_rest_on(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    model = learning.boosted(df.where("k % 4 <> 0"), ["a", "b"], "y", trees=5)
    test = df.where("k % 4 = 0")
    assert model.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.9
    rest = learning.importance(model, df, "k", ["a", "b"], "y")
    assert rest[0][0] == "a" and rest[0][1] > 0.2 > abs(rest[1][1])


def test_typed_files_and_instants(spark, tmp_path):
    from receiptlake.functions import dates

    (tmp_path / "t.csv").write_text('id,total,at\n1,2.50,2020-01-02 03:04:05\n2,x,\n')
    got = readers.csv_typed(spark, str(tmp_path / "t.csv"), "id long, total double, at timestamp").select("id", "total", dates.iso_instant(F.col("at")).alias("at")).collect()
    assert [tuple(r) for r in got] == [(1, 2.5, "2020-01-02T03:04:05.000Z"), (2, None, None)]
