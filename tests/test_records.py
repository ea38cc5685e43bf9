import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from receiptlake import session
from receiptlake.functions import hashing, scores, text
from receiptlake.operators import dedup, evaluation, learning, ranking, sampling, windows
from receiptlake.plans import quality
from receiptlake.sources import readers, writers


@pytest.mark.parametrize("distance", [0, 3, 6, 12])
def test_near_hashes_equal_brute_force_under_any_plan(spark, distance, monkeypatch):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(6)]
    rows = [(i, h - (1 << 64) if h >= 1 << 63 else h) for i, h in enumerate(hashes)] + [(900, None), (901, 7), (902, 7)]
    df = spark.createDataFrame(rows, "k long, h long")
    want = {(i, j) for i, a in rows for j, b in rows if i < j and None not in (a, b) and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance}
    for n in (100, 10**6):
        monkeypatch.setattr(dedup.hashing, "band_plan", lambda _, d, n=n: plan(n, d))
        assert {(r.a, r.b) for r in dedup.hash_pairs(df, "k", F.col("h"), distance).collect()} == want
    n_near = {}
    for pair in want:
        for k in pair:
            n_near[k] = n_near.get(k, 0) + 1
    assert {r.k: r.n_near for r in dedup.hash_links(df, "k", F.col("h"), distance).collect()} == n_near


plan = hashing.band_plan


def test_nearest_is_the_same_in_blocks(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.getrandbits(62)) for i in range(200)] + [(500, None)], "k long, h long")
    one = sorted(tuple(r) for r in dedup.nearest(df, df.where("k % 5 = 0"), "k", F.col("h")).collect())
    assert len(one) == 200 and one == sorted(tuple(r) for r in dedup.nearest(df, df.where("k % 5 = 0"), "k", F.col("h"), held=7).collect())
    assert dedup.nearest(df, df.limit(0), "k", F.col("h")).count() == 0


def test_ranks_numbers_and_strata_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET", 50)
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "cool").alias("c"))
    got = sampling.stratified(df, "id", "c", [("a", 0.7), ("b", 0.3)]).groupBy("stratum", "split").agg(F.count("*").alias("n")).collect()
    assert {(r.stratum, r.split): r.n for r in got} == {("hot", "a"): 630, ("hot", "b"): 270, ("cool", "a"): 62, ("cool", "b"): 28, ("", "a"): 7, ("", "b"): 3}
    n = windows.numbered(df, ["c"], ["id"], "n")
    assert n.groupBy("c").agg(F.count_distinct("n").alias("d"), F.max("n").alias("m"), F.count("*").alias("n")).where("d <> n OR m <> n").isEmpty()
    folds = sampling.stratified_group_folds(df.withColumn("g", (F.col("id") / 3).cast("int").cast("string")), F.col("g"), "c", 5)
    spread = folds.where("label = 'hot'").groupBy("fold").agg(F.count("*").alias("n")).collect()
    assert len(spread) == 5 and max(r.n for r in spread) - min(r.n for r in spread) <= 1


def test_sources_fail_or_stay_empty_as_they_should(spark, tmp_path):
    assert readers.store(spark, str(tmp_path / "none"), "a string, b long").count() == 0
    (tmp_path / "s.json").write_text('{"a": "x", "b": 1}\n{oops\n{"a": "y"}\n')
    assert {tuple(r) for r in readers.store(spark, str(tmp_path / "s.json"), "a string, b long").collect()} == {("x", 1), ("y", None)}
    with pytest.raises(FileNotFoundError, match="predictions"):
        readers.keyed(spark, str(tmp_path / "none.csv"), ["a"], "predictions")
    a = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.25)], "k long, y int, p double")
    assert sorted(tuple(r) for r in readers.aligned({"m": a, "n": a}, "k", "y", "p").collect()) == [(1, 0, 0.5, 0.5), (2, 1, 0.25, 0.25)]
    for bad in (a.where("k = 1"), a.withColumn("y", F.lit(1))):
        with pytest.raises(PySparkException, match="disagree"):
            readers.aligned({"m": a, "n": bad}, "k", "y", "p").collect()
    assert learning.loaded(str(tmp_path / "none"), 3) is None and learning.loaded(str(tmp_path / "none"), 3) is None


def test_tables_are_replaced_audited_and_emptied(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    one = writers.rewritten_once(rows, path, {"u": F.upper("v")}).collect()
    assert sorted(writers.rewritten_once(rows.limit(0), path, {"u": F.upper("v")}).collect()) == sorted(one) and len(one) == 2
    writers.audited(rows.limit(1), rows, f"{path}-rows", f"{path}-audit")
    with pytest.warns(UserWarning, match="no audit"):
        writers.audited(rows.limit(1), rows, f"{path}-rows", "nosuch://x/y")
    assert spark.read.parquet(f"{path}-rows").count() == 2
    assert writers.truncated(spark, [path, f"{path}-rows"]) == 0 and spark.read.parquet(path).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_intermediate_tables_can_be_cleared(spark):
    df = session.cut(spark.range(5), "x")
    assert df.count() == 5
    files = df.inputFiles()
    assert session.run_dir(spark) in files[0]


def test_texts_scores_and_choices(spark):
    df = spark.createDataFrame([(1234567, "Rate limit hit"), (999, "MODEL NOT FOUND"), (-100000, None), (5, "boom")], "n long, m string")
    got = [tuple(r) for r in df.select(text.lakh_grouped(F.col("n")), text.error_class(F.col("m"))).collect()]
    assert got == [("12,34,567", "quota"), ("999", "unsupported"), ("-1,00,000", None), ("5", "permanent")]
    with pytest.raises(ValueError, match="nothing"):
        scores.fused([(F.lit(1.0), 0.0)])
    m = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.1, 0.7), ("c", 0.1, 0.9), ("d", 0.05, 0.9)], "model string, fpr double, recall double")
    assert evaluation.best_of(m).first().model == "d" and evaluation.best_of(m.where("fpr > 0.2")).first().model == "a"
    s = learning.flagged_share(spark.range(100).select("id", F.col("id").cast("double").alias("s")), "s", 0.12)
    assert s.where("flagged").count() == 12
    picks = sampling.weighted_pick(spark.range(3000).select(F.col("id").cast("string").alias("u"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("c")).withColumn("w", F.when(F.col("c") == "x", 3.0).otherwise(1.0)), "u", "c", "w")
    assert 0.7 < picks.where("c = 'x'").count() / 3000 < 0.8
    ratings = sampling.synthetic_ratings(200, ["a", "b", "c"], 10, spark)
    assert ratings.count() == 2000 and ratings.agg(F.min("rating"), F.max("rating")).first() == (2, 5)


def test_streams_read_tables_of_many_files_as_those_of_one(spark, tmp_path):
    name = "firestore_receipts.parquet"
    want = sorted(quality.stream_pipeline(spark, "/root/testdata/sf0.001").collect())
    rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}")
    rows.repartition(3).write.parquet(f"{tmp_path}/{name}")
    assert want and sorted(quality.stream_pipeline(spark, str(tmp_path)).collect()) == want
    rows.limit(0).write.parquet(f"{tmp_path}/none/{name}")
    assert quality.stream_pipeline(spark, f"{tmp_path}/none").count() == 0
