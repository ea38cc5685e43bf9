import random


from receiptlake.llm import overlap, setjoin


def test_joins_equal_brute_force(spark):
    random.seed(1)
    base = [random.sample(range(60), random.randint(3, 12)) for _ in range(40)]
    sets = [(i, sorted(set(b) ^ set(random.sample(range(60), random.randint(0, 3))))) for i, b in enumerate(base * 3)]
    sets += [(500, []), (501, [1]), (502, [1])]
    df = spark.createDataFrame(sets, "id long, tokens array<bigint>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
    for t in (0.4, 0.6, 0.8, 1.0):
        want = {(i, j) for i, a in sets for j, b in sets if i < j and jac(a, b) >= t - 1e-9}
        assert {(r.a, r.b) for r in setjoin.self_join(df, t).collect()} == want
        l, r = df.where("id % 2 = 0"), df.where("id % 2 = 1")
        assert {(x.a, x.b) for x in setjoin.bipartite(l, r, t).collect()} == {(i, j) for i, a in sets for j, b in sets if i % 2 == 0 and j % 2 == 1 and jac(a, b) >= t - 1e-9}


def test_overlaps_across_splits(spark):
    rows = [
        (1, "a/receipt_00001105.png", "CORD", "train"), (2, "b/receipt-1105 (1).jpg", "CORD", "test"), (3, "b/receipt_00001106.png", "CORD", "test"), (4, "a/scan-tools-hunler-00159135.jpeg", "uk", "val"), (5, "data/scan_tools_hulner_159135.webp", "uk", "train"),
        (6, "a/receipt_00001105.png", "SROIE", "val"), (7, None, "CORD", "test"), (8, "a/receipt_00001105.png", None, "train"), (9, "a/receipt_00001105.png", "CORD", "train"), (10, "a/receipt_00001105.png", "CORD", None), (11, "", "CORD", "train"), (2, "b/receipt-1105 (1).jpg", "CORD", "test"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "rec_id long, image_path string, source string, split string, name string")
    found, _, names = overlap.image_overlaps(df)
    p = overlap.overlapping_pairs(found, names)
    assert sorted((r.rec_id_a, r.rec_id_b) for r in p.collect()) == [(1, 2), (1, 2), (2, 9), (2, 9), (4, 5)]
    rep = {(r.split, r.source): (r.n_rows, r.n_overlapping, r.n_pairs, r.n_exact_pairs) for r in overlap.overlap_report(found, names).collect()}
    assert rep["test", "CORD"] == (3, 2, 4, 4) and rep["val", "uk"] == (1, 1, 1, 0) and rep["val", "SROIE"] == (1, 0, 0, 0)
    e = overlap.image_overlaps(df.limit(0))
    assert overlap.overlapping_pairs(e[0], e[2]).count() == 0


def test_prefixes_keep_rare_tokens_first(spark):
    df = spark.createDataFrame([(i, [1, 100 + i]) for i in range(20)], "id long, tokens array<bigint>")
    assert all(r.toks[-1] == 1 for r in setjoin.ranked_sets(df).collect())
    assert setjoin.self_join(df, 0.9).isEmpty()
