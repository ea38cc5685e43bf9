import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from receiptlake.llm import packing, tokens, truncation

PATH = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"
needs = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@needs
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from("ab 'sllre 12²\n\té中文ि😀"), max_size=80), st.integers(1, 20))
def test_tree_equals_whole(text, leaf):
    v = tokens.vocabulary(PATH)
    ids = v.encode(text, leaf)
    assert ids == v.leaf(text) and v.decode(ids) == text


@needs
def test_ids_equal_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", None, " ", "a <|endoftext|> b", "RM 5.00 मलेशिया 收据\r\n", "x" * 70_000, "word " * 20_000, "中" * 40_000]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)] + [(0, "", "c")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encoded(df).collect()}
    assert got[0] == [] and got[1] == [] and tokens.encoded(df).count() == len(texts) + 1
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
    assert tokens.encoded(df.limit(0)).count() == 0


def test_packing_is_whole_and_near_the_bound(spark):
    random.seed(3)
    sizes = [random.choice([0, 1, 5, 40, 90, 91, 300, 700, 1025, 2048, 2049, 9000, random.randint(1, 2500)]) for _ in range(800)] + [random.randint(1, 600) for _ in range(4000)]
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)] + [(0, sizes[0], 0), (-1, None, 0)], "doc_id long, n long, container long")
    got = packing.packed(df, "doc_id", F.col("n")).cache()
    rows = got.collect()
    assert sum(r.n_tokens for r in rows) == sum(sizes) + sizes[0]
    spans = {}
    for r in rows:
        spans.setdefault(r.container, []).append((r.start, r.start + r.n_tokens))
    for s in spans.values():
        s.sort()
        assert s[-1][1] <= packing.CAPACITY and all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.first, r.n_tokens))
    assert all(len(p) == 1 or sizes[k] > packing.CAPACITY or k == 0 for k, p in parts.items())
    rep = packing.report(got).first()
    assert rep.n_containers <= rep.least_containers * 1.02 + 1 and sorted(spans) == list(range(rep.n_containers))
    assert rep.most_in_step - rep.least_in_step <= 1 and rep.most_step_fill - rep.least_step_fill < 0.05
    for r in rows:  # in one window of its tier, which is no shorter than its own
        w = packing.window(r.tier, packing.CAPACITY)
        assert r.start // w == (r.start + r.n_tokens - 1) // w and r.tier <= r.own_tier == packing.tier_of(r.n_tokens, packing.CAPACITY)
    tiers = {r.tier: r for r in packing.tier_report(got).collect()}
    assert sorted(tiers) == [0, 1, 2, 3] and sum(r.n_tokens for r in tiers.values()) == sum(r.n_tokens for r in rows) and tiers[3].filled_tokens == 0
    assert packing.packed(df.limit(0), "doc_id", F.col("n")).count() == 0


def test_patterns_hold_all_items():
    random.seed(5)
    for _ in range(100):
        counts = {random.randint(1, 100): random.randint(1, 50) for _ in range(random.randint(1, 20))}
        left = dict(counts)
        for tier, times, used in packing.patterns(counts, 100):
            assert sum(s * n for s, n in used) <= packing.window(tier, 100) and packing.tier_of(used[0][0], 100) == tier
            for s, n in used:
                left[s] -= times * n
        assert not any(left.values())


ENDS = [
    ("The bill was paid and the rest was kept in the draw", True, "prose"), ("The bill was paid yesterday.", False, "prose"), ("The total is ri�", True, "prose"), ("They put the points on...", True, "prose"), ("The bill was paid yesterday. ​🙏", False, "prose"), ("Paid.</p>", False, "prose"), ("यह ठीक है।", False, "prose"),
    ("All fine.\n\nBest wishes,\nMavon", False, "prose"), ("All fine.\n\nRegárds\nMavon", False, "prose"), ("All fine.\n\nBest wis", True, "prose"), ("ok thanks", False, "chat"), ("still waiting...", False, "chat"), ("same problem he", True, "chat"), ("X\nTOTAL 3.10\nTHANK YOU", False, "receipt"), ("X\nTOTAL 3.10\nTHAN", True, "receipt"), ("", False, "prose"), (None, False, "prose"), ("  ", False, "prose"),
]


def test_endings(spark):
    rows = [(i, t, k) for i, (t, _, k) in enumerate(ENDS)]
    rows += [(1000 + i, f"Somebody at the desk said {i} bills were paid.", "prose") for i in range(60)]
    rows += [(2000 + i, ["ok thanks", "same problem here", "still waiting...", "any news?", f"receipt {i} again"][i % 5], "chat") for i in range(60)]
    rows += [(3000 + i, f"SHOP\nTEA {i}.00\n{['THANK YOU', 'CHANGE 1.20'][i % 2]}", "receipt") for i in range(60)]
    df = spark.createDataFrame([(k, t, kd, "s", True) for k, t, kd in rows], "doc_id long, text string, doc_type string, source string, cut boolean")
    got = truncation.endings(df)
    cut = {r.doc_id: r.cut for r in got.collect()}
    assert len(cut) == len(rows) and [cut[i] for i in range(len(ENDS))] == [c for _, c, _ in ENDS]
    assert not any(cut[k] for k, _, _ in rows if k >= 1000)
    rep = truncation.report(got).first()
    assert rep.n_docs == len(rows) and rep.n_cut == sum(c for _, c, _ in ENDS)
    assert truncation.endings(df.limit(0)).count() == 0


def test_endings_do_not_fade_with_size_and_copies(spark):
    chat = [(100 + i, f"order {chr(97 + i) * 3} has the same problem he", "chat", True) for i in range(8)] + [(110, "the same old pro", "chat", True)] * 6
    chat += [(200 + i, f"order {chr(97 + i) * 3} {x}", "chat", False) for i in range(20) for x in ("has the problem here", "is here again", "was ok with them")]
    chat += [(400, "put it on again and on", "chat", False), (401, "ongoing", "chat", False)] + [(402 + i, f"still ongoing today {chr(97 + i) * 3}", "chat", False) for i in range(6)]
    receipts = [(500 + i, f"SHOP\nTEA {i}.00\n{['THANK YOU', 'CHANGE 1.20'][i % 2]}", "receipt", False) for i in range(60)] + [(600, "X\nTOTAL 3.10\nTHAN", "receipt", True)] * 10
    prose = [(700 + i, f"Somebody at desk {i} said bills were paid.", "prose", False) for i in range(30)] + [(800, "The bill was paid and put in the draw", "prose", True)] * 20
    rows = [*chat, *receipts, *prose]
    df = spark.createDataFrame([(k, t, kd, "s") for k, t, kd, _ in rows], "doc_id long, text string, doc_type string, source string")
    got = {r.doc_id: r.cut for r in truncation.endings(df).collect()}
    assert got == {k: c for k, _, _, c in rows}
