import os

import pytest
from pyspark.sql import functions as F

from receiptlake.llm import addresses, names, orgnames, postal
from receiptlake.llm.groups import HELD
from receiptlake.llm.unionfind import components

SAME_PLACE = [
    "NO 342A, JALAN KIRSA 10/2, TAMAN NODIN, 50570 PORT WAIHE, KARWU.", "342A, Jalan Kirsa 10/2, Taman Ndoin, 50570, Port Waihe, Karwu", "No. 342A, Jl Kirsa 10/2, Port Waihe 50570, Karwu", "No.342 A\nJALAN KIRSA 10/2\nTAMAN NODIN\nPORT. WAIHE 50570\nKAR",
    "no:342a,jalan k1rsa 10/2,off taman nodin,port waihe 505 70,karwu", "TAMAN NODDIN - #342 A - JALAN KIRSA 10/2 - PORT WAIHE",
]
OTHERS = ["NO 333A-G, JALAN KIRSA 10/2, TAMAN NODIN, 50570 PORT WAIHE, KARWU.", "NO 342A-1, JALAN KIRSA 10/2, TAMAN NODIN, 50570 PORT WAIHE, KARWU.", "NO 342B, JALAN KIRSA 10/2, TAMAN NODIN, 50570 PORT WAIHE, KARWU.", "NO 342A, JALAN KIRSA 10/3, TAMAN NODIN, 50570 PORT WAIHE, KARWU."]


RULES = {"GRD": "GROUND", "FLR": "FLOOR", "JLN": "JALAN", "TMN": "TAMAN"}


@pytest.mark.parametrize(("text", "wanted"), [("LOT 316 A (TINGKAT 2), LORONG NUNKE 10/10", ("316", "A", "2", "NUNKE", "10/10")), ("GRD FLR, #302 A,Persiaran Krairsi 1/6", ("302", "A", "G", "KRAIRSI", "1/6")), ("JALANHAMWEN 7 - 2ND FLR, 117B", ("117", "B", "2", "HAMWEN", "7")), ("JLNHAMWEN 7 - 2ND FLR, 117B", ("117", "B", "2", "HAMWEN", "7")), ("TMN. X,No.7 B-1,JLN. KUGAIN 11 / 3", ("7", "B", "1", "KUGAIN", "11/3"))])
def test_addresses_are_read(text, wanted):
    assert postal.read(text, RULES)[:5] == wanted


def test_addresses_are_not_read_by_what_is_not_mined():
    assert postal.read("GRD FLR, 302 A, JLN KRAIRSI 6")[2:5] == ("", "", "")


@pytest.mark.parametrize("held", [HELD, 3])
def test_places(spark, held, monkeypatch):
    monkeypatch.setattr(addresses.salted, "__defaults__", (held,))
    monkeypatch.setattr(addresses._located, "__defaults__", (held,))
    rows = [(i, a) for i, a in enumerate(SAME_PLACE + OTHERS)] + [(50, None), (51, ""), (52, "  "), (53, SAME_PLACE[0]), (54, "x" * 20000), (55, "MEDAN X"), (56, "MEDAN X")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "entity_id long, address string, place string")
    by = {}
    for r in addresses.places(df).collect():
        by.setdefault(r.place, set()).add(r.entity_id)
    assert {0, 1, 2, 3, 4, 5, 53} in by.values() and all({i} in by.values() for i in (6, 7, 8, 9)) and {55, 56} in by.values()
    n = addresses.pairs(addresses.places(df)).count()
    assert n == 7 * 6 // 2 + 1
    assert addresses.places(df.limit(0)).count() == 0


def test_rewrites_are_mined_from_places_that_agree(spark):
    rows = [(f"NO {n}, JALAN ROAD{chr(65 + n)}X 1/{n % 9 + 1}, {t} GREEN, 5057{n % 10} TOWN",) for n in range(12) for t in ("TAMAN", "TMN")] + [(f"NO {n}, JALAN AREA{chr(65 + n)}X 1/{n % 9 + 1}, TAMAN GREEN, 40570 TOWN",) for n in range(12)]
    read = spark.createDataFrame(rows, "address string").mapInPandas(addresses._reader({}), addresses._READ)
    assert addresses.rewrites(read, {"TMN": 12, "TAMAN": 24}) == {"TMN": "TAMAN"}


def test_a_rewrite_brings_more_to_agree(spark):
    street = lambda n: f"{'BCDFGHJKLM'[n % 10]}AR{'AEIOU'[n % 5]}N"
    rows = [f"NO {n}, {w} {street(n)} 1/{n % 9 + 1}, TAMAN GREEN, 5057{n % 10} TOWN" for n in range(10) for w in ("JALAN", "JLN", "JALAN")]
    rows += [f"NO {n}, {w} {street(n)} {n + 1}, {t} BLUE, 6057{n % 10} TOWN" for n in range(10) for w, t in (("JALAN", "TAMAN"), ("JLN", "TMN"), ("JALAN", "TAMAN"))]
    df = spark.createDataFrame(list(enumerate(rows)), "entity_id long, address string")
    _, rules = addresses.renormalised(df.select("address").distinct())
    assert rules == {"JLN": "JALAN", "TMN": "TAMAN"}  # the second is only seen where the first has been rewritten
    assert addresses.places(df).select("place").distinct().count() == 20


@pytest.mark.parametrize("held", [3, 40])
def test_places_do_not_depend_on_what_a_task_holds(spark, held, monkeypatch):
    path = "/root/testdata/sf0.01/sroie_entities.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    whole = addresses.pairs(addresses.places(df)).toPandas()
    monkeypatch.setattr(addresses.salted, "__defaults__", (held,))
    monkeypatch.setattr(addresses._located, "__defaults__", (held,))
    parts = addresses.pairs(addresses.places(df)).toPandas()
    assert set(map(tuple, whole.to_numpy())) == set(map(tuple, parts.to_numpy()))


SHORT = {"ENT": "ENTERPRISE", "MKT": "MARKET", "HWARE": "HARDWARE"}


@pytest.mark.parametrize(("name", "trade", "words"), [("M/S BEPUN MIRHETE ENT. SDN BHD @ SUNGAI HINKREN", "enterprise", ["BEPUN", "MIRHETE"]), ("K. BUKU SURE YEMERU LTD", "books", ["SURE", "YEMERU"]), ("CAFERF0, PERZAIR ELECTRICAL", "electrical", ["CAFERFO", "PERZAIR"]), ("KARDEN & GANTESA CAFE", "cafe", ["KARDEN", "GANTESA"]), ("JOONRORBI M.MKT LTD", "mini market", ["JOONRORBI"]), ("D. KRABAINWEN SUPER MKT S/B - BERKO", "supermarket", ["D", "KRABAINWEN"])])
def test_names_are_read(name, trade, words):
    assert orgnames.parse(name, SHORT)[:2] == (trade, words)


@pytest.mark.parametrize(("a", "b", "wanted"), [("D", "DONMIR", True), ("DAN", "DANGAR", True), ("GUNZY", "GUNZA", True), ("KURI", "BIRKUR", True), ("KRIRSA", "KIRSA", True), ("TUNVE", "RANGE", False), ("", "X", False)])
def test_words_that_may_stand_for_others(a, b, wanted):
    assert orgnames.compatible(a, b) is wanted


GROUPS = [
    ["DONMIR KRABAINWEN SUPERMARKET", "D. KRABAINWEN SUPERMARKET", "KRABAINWEN, DONMIR SUPER MKT SDN BHD", "DONMIR KRABAINWIN SUPERMARKET", "DONMIRKRABAINWEN SUPERMARKET", "DONMIR KRAB-AINWEN SUPERMARKET @ KAMPUNG DEFAI", " donmir  krabainwen supermarket "],
    ["DONMIR KRABAINWEN HARDWARE", "DONMIR KRABAINWEN H/WARE PVT LTD"],
    ["GARZA VARSORVAIN TEXTILES"],
    ["CUKA JIZANBE", "CUKA JIZANBE KEDAI KOPI", "KEDAI KOPI CUKA JIZANBE SDN BHD"],
]


@pytest.mark.parametrize("held", [HELD, 2])
def test_organisations(spark, held, monkeypatch):
    monkeypatch.setattr(names, "trade_words", lambda n: SHORT)
    monkeypatch.setattr(names._linked, "__defaults__", (held,))
    flat = [n for g in GROUPS for n in g]
    df = spark.createDataFrame([(n, "o") for n in [*flat, *flat, None, "", "  ", "UNKNOWN"]], "merchant string, org string")
    other = spark.createDataFrame([("KEDAI KOPI CUKA JIZANBE SDN BHD",), ("Z" * 5000,)], "company string")
    got = names.organisations(names.names_of(df.select("merchant"), other))
    by = {}
    for r in got.collect():
        by.setdefault(r.org, set()).add(r.name)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [*GROUPS, ["Z" * 5000]]))
    p = names.pairs(got)
    assert p.count() == sum(len(g) * (len(g) - 1) // 2 for g in GROUPS) and p.where(F.col("name_a") >= F.col("name_b")).isEmpty()
    assert names.organisations(names.names_of(df.limit(0).select("merchant"))).count() == 0


def test_a_common_word_hides_no_links(spark):
    trades = ["HARDWARE", "BAKERY", "KLINIK", "TEXTILES"]
    many = [f"CUKA {a}{b}{c}{d} {trades[i % 4]}" for i, (a, b, c, d) in enumerate((a, b, c, d) for a in ("FAM", "GOL", "HEP") for b in ("TU", "VO", "WI") for c in ("NAR", "SEK", "DUM", "LOP", "ZIT") for d in ("BO", "CHE", "PLA", "QUI", "XEN"))]
    same = [["CUKA JIZNBE", "KEDAI KOPI CUKA JIZANBE"], ["CUKA BIZAN KEDAI KOPI", "CUKA RIZAN KEDAI KOPI"], ["CUKA Y KEDAI KOPI", "CUKA YUNDER KEDAI KOPI"]]
    apart = ["CUKA YARMOS OPTICAL"]
    df = spark.createDataFrame([(n,) for n in [*many, *apart, *(n for g in same for n in g)]], "name string")
    org = {r.name: r.org for r in names.organisations(df).collect()}
    assert len(many) > 200 and all(org[a] == org[b] for a, b in same)
    assert len({org[g[0]] for g in same} | {org[n] for n in apart}) == 4


def test_heads_of_parts_meet_though_linked_elsewhere(spark):
    others = ["DONMIR", "DONMIT", "DONMIX", "DONMIRA", "DONIMR", "DOMIR", "DONMI", "FONMIR"]
    hot = [("HOT", f"p{i}", o, "cafe", 20 - i) for i, o in enumerate(others)] + [("HOT", "open", "D", "cafe", 1), ("HOT", "far", "DANGUS", "cafe", 1), ("HOT", "bare", "DONMIR", "", 1)]
    small = [(f"s{i}", f"{x}{i}", "WORD", "cafe", n) for i in range(len(others)) for x, n in (("p", 1), ("z", 99))]
    df = spark.createDataFrame(hot + small, "key string, profile string, other string, trade string, n long")
    for held in (2, 3, HELD):
        comp = {r.node: r.component for r in components(names._linked(df, held)).collect()}
        assert {comp.get(x, x) for x in ["bare", *(f"{x}{i}" for x in "pz" for i in range(len(others)))]} == {"bare"}
        assert not {"open", "far"} & set(comp)


def test_slips_meet_whatever_the_edit(spark):
    same = [
        ("RESTORAN ROKRY & BIPAZNI LTD", "RESTORAN ROKRIR & BIPANZI LTD"), ("D LOMTER HARDWARE", "DANVOS LOTMER HARDWARE"), ("KU SANVIRO OPTICAL", "KU SAVNRIO OPTICAL"), ("FU GEMPA TEXTILES", "FUNDOR GEPMA TEXTILES"),
        ("HENTURYAYANJU BAKERY", "HNETURYAYAJNU BAKERY"), ("MILDE ZUNKA TORBE CLINIC", "MIDLE ZUNKA TOBRE CLINIC"),
    ]
    apart = ["RESTORAN ROKRIR & BUPUNGI LTD", "EDANVOS LOTMER BAKERY", "KU SENDERO OPTICAL"]
    df = spark.createDataFrame([(n,) for n in [*apart, *(n for g in same for n in g)]], "name string")
    org = {r.name: r.org for r in names.organisations(df).collect()}
    assert [g for g in same if org[g[0]] != org[g[1]]] == [] and len(set(org.values())) == len(same) + len(apart)


def test_slips_of_large_groups_meet(spark):
    words = ["KRABAINWEN", "KRABIANWNE", "KARBAINWEN", "DONSELIRGA", "DONSLEIRG"]
    df = spark.createDataFrame([(w, "cafe", sorted(["CUKA", w])) for w in words], "profile string, trade string, words array<string>")
    for held in (2, HELD):
        comp = {r.node: r.component for r in components(names.near(df, held)).collect()}
        assert [comp.get(w, w) for w in words] == ["KARBAINWEN"] * 3 + ["DONSELIRGA"] * 2


def test_rewrites_are_mined_until_none_is_new(spark, monkeypatch):
    chain = ["A", "B", "C", "D", "E", "F", "G", "H"]
    rules = iter([*({a: b} for a, b in zip(chain, chain[1:])), {}])
    monkeypatch.setattr(addresses, "rewrites", lambda read, freq: next(rules))
    df = spark.createDataFrame([(f"NO 12, JALAN KIRSA 10/2, TAMAN NODIN {i}, 50570 PORT WAIHE",) for i in range(2)], "address string")
    assert addresses.renormalised(df)[1] == dict.fromkeys(chain[:-1], "H")
    assert next(rules, None) is None


def test_words_of_trades_are_mined(spark):
    own = [f"{a}{b} {c}{a}{b}" for a in ("KURSAN", "DONMIR", "VOTENG", "HARLUN") for b in ("A", "OBI", "EVA") for c in ("ZIR", "PAL")]
    rows = [f"{n} {t}" for i, n in enumerate(own) for t in (("BAKERY", "BKRY SDN BHD") if i % 2 else ("HARDWARE", "H/WARE"))] + [f"{n} TEXTILES" for n in own[::3]]
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    assert names.trade_words(df) == {"BKRY": "BAKERY", "HWARE": "HARDWARE"}
    assert names.trade_words(df.limit(0)) == {}
    org = {r.name: r.org for r in names.organisations(df).collect()}
    assert all(org[f"{n} {a}"] == org[f"{n} {b}"] for i, n in enumerate(own) for a, b in [("BAKERY", "BKRY SDN BHD") if i % 2 else ("HARDWARE", "H/WARE")])
    assert all(org[f"{n} TEXTILES"] != org[f"{n} {t}"] for i, n in enumerate(own) if i % 3 == 0 for t in [("BAKERY" if i % 2 else "HARDWARE")])


def test_rare_words_count_more():
    rare, common = 8.0, 2.0
    one = [("CUKA", common), ("JIZANBE", rare)]
    assert names.soft_similarity(one, one) == pytest.approx(1)
    assert names.soft_similarity(one, [("CUKA", common), ("JIZNBE", rare)]) > 0.85
    assert names.soft_similarity(one, [("CUKA", common), ("YARMOS", rare)]) < names.ALIKE < names.soft_similarity(one, [("C", common), ("JIZANBE", rare)])
    assert names.soft_similarity(one, [("CUKI", common), ("JIZANBE", rare)]) > names.soft_similarity(one, [("CUKA", common), ("JIZANBEXY", rare)])
    assert names.soft_similarity([], one) == 0.0
