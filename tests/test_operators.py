import itertools

from compare import DATA
from pyspark.sql import functions as F

from pagewright.operators import joins, ordered, ranking
from pagewright.operators.ingest import unique_headers
from pagewright.plans.allocate import allocate, place_products
from pagewright.plans.assemble import contents_pages
from pagewright.queries.matching import q_asset_match
from pagewright.streaming.stateful import admissions, admit, circuit, trip


def test_majority_takes_the_first_on_ties(spark):
    rows = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", " ", 3), ("k", "a", 4), ("k", "b", 5)], "k string, v string, o int")
    assert [(r["v"], r["n"]) for r in ranking.majority(rows, ["k"], "v", "o").collect()] == [("b", 2)]


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 7), ("b", None)], "k string, v int")
    assert {r["k"]: r["median"] for r in ranking.upper_medians(rows, "k", "v").collect()} == {"a": 3, "b": 7}


def test_band_join_equals_nested_loops(spark):
    left = [(k % 3, float(v)) for k, v in enumerate((0, 2, 5, 9, 9, 14, -3, -1))]
    right = [(k % 3, v + 0.5) for k, v in enumerate((0, 3, 5, 9, 12, 13, -4))]
    got = joins.band_join(spark.createDataFrame(left, "k int, a double"), spark.createDataFrame(right, "k int, b double"), ["k"], "a", "b", 2.0).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, a, b) for (k, a), (j, b) in itertools.product(left, right) if k == j and abs(a - b) <= 2)


def test_interval_join_equals_nested_loops(spark):
    points = [(k % 2, float(v)) for k, v in enumerate(range(0, 300, 13))]
    spans = [(k % 2, float(v), float(v + w)) for k, (v, w) in enumerate([(0, 10), (5, 100), (60, 4), (64, 64), (250, 0), (200, 90)])]
    got = joins.in_interval(spark.createDataFrame(points, "k int, at double"), spark.createDataFrame(spans, "k int, lo double, hi double"), ["k"], "at", "lo", "hi").collect()
    assert sorted(tuple(r) for r in got) == sorted((k, p, lo, hi) for (k, p), (j, lo, hi) in itertools.product(points, spans) if k == j and lo <= p < hi)


def test_match_tiers(spark):
    names = spark.createDataFrame([(1, "AB12"), (2, "Mégère"), (3, "0012345"), (4, "REF-AB99-2024"), (5, "zzz9"), (6, "Evier Opale")], "id int, name string")
    assets = spark.createDataFrame([("ab12", 1), ("megere", 2), ("12345", 3), ("ab99", 4), ("x evier-opale y", 5)], "stem string, o int")
    got = {r["id"]: (r["asset"], r["tier"]) for r in joins.match_tiers(names, assets, "id", "name", "stem", "o").collect()}
    assert got == {1: ("ab12", 1), 2: ("megere", 2), 3: ("12345", 5), 4: ("ab99", 5), 5: (None, None), 6: ("x evier-opale y", 6)}


def tiers_by_hand(names, assets):
    """The tiers, pair by pair; keys of plain letters and digits."""
    bare = lambda x: "".join(c for c in x if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    out = {}
    for i, name in names:
        c, found = name.lower(), []
        cn = bare(c)
        cz = cn.lstrip("0")
        for asset, o in assets:
            b = asset.lower()
            bn = bare(b)
            bz = bn.lstrip("0")
            tests = [c == b, False, b.startswith(c), c in b, len(b) >= 4 and b in c, len(cn) >= 3 and cn in bn, len(cn) >= 3 and len(bn) >= 4 and bn in cn]
            tests += [len(cz) >= 3 and cz != cn and cz in bn, len(cn) >= 3 and len(bz) >= 3 and cn in bz]
            found += [(tests.index(True) + 1, o, asset)] if any(tests) else []
        out[i] = min(found)[::2][::-1] if found else (None, None)
    return out


def test_match_tiers_of_short_names_and_other_scripts(spark):
    names = ["007", "A1", "0012", "Лампа", "灯", "x", "", "00", "0-0-1", "№", "Q", "лампа настольная 5", "a.b.c", "long name that is contained in another", "ab-12 34567890 zz"]
    assets = ["img 0012", "agent 007", "a1-front", "b a1", "фото лампа", "настольная", "灯 2", "box", "000", "0 01x", "№5", "a b c d", "the long name that is contained in another one", "1234567890", "p q"]
    names, assets = list(enumerate(names)), [(x, i) for i, x in enumerate(assets)]
    got = joins.match_tiers(spark.createDataFrame(names, "id int, name string"), spark.createDataFrame(assets, "stem string, o int"), "id", "name", "stem", "o").collect()
    want = tiers_by_hand(names, assets)
    assert {r["id"]: (r["asset"], r["tier"]) for r in got} == want
    assert [want[i] for i in (0, 1, 2, 3)] == [("agent 007", 4), ("a1-front", 3), ("img 0012", 4), ("фото лампа", 4)]


def test_asset_match_takes_all_parts(spark):
    part = [(r["p_partkey"], r["p_name"]) for r in spark.read.parquet(f"{DATA}/part.parquet").collect()]
    assets = {}
    for k, name in part:
        low = name.lower()
        stem = (low, low + "-v2", low.replace(" ", "_"), "img " + low, name[:5])[k % 5]
        assets[stem] = min(k, assets.get(stem, k))
    got = {r["p_partkey"]: (r["asset"], r["tier"]) for r in q_asset_match(spark, DATA).collect()}
    assert got == tiers_by_hand(part, list(assets.items()))


def test_headers_of_blank_families(spark):
    rows = [(1, "", "", "a"), (2, "F", "s", "b"), (3, "F", "s", "c"), (4, "F", "", "d"), (5, "F", "s", "e"), (6, "", "", "f"), (7, "", "t", "g")]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, o int, fam string, sub string, label string")
    got = [(r["kind"], r["text"]) for r in ordered.hierarchy_headers(df, ["k"], ["o"], "fam", "sub", "label").orderBy("position").collect()]
    assert got == [("row", "a"), ("family", "F"), ("subfamily", "s"), ("row", "b"), ("row", "c"), ("row", "d"), ("row", "e"), ("family", "Autres"), ("row", "f"), ("subfamily", "t"), ("row", "g")]


def test_anchored_groups(spark):
    row = spark.range(1).select(ordered.anchored_groups(F.array(*map(F.lit, (5.0, 0.0, 4.0, 8.0, 9.5))), 4.0).alias("g")).first()
    assert row["g"] == [[0.0, 4.0], [5.0, 8.0], [9.5]]


def test_unique_headers():
    assert unique_headers(["a", "", "a", "a", " "]) == ["a", "Col2", "a (2)", "a (3)", "Col5"]


def test_allocation_cases():
    page = lambda *blocks: {i: ("", b) for i, b in enumerate(blocks)}
    pages_used = lambda rows: sorted(sum(1 for r in rows if r[1] == p) for p in {r[1] for r in rows if r[1] is not None})
    assert place_products({"s": []}, page(3)) == []
    assert [r[3] for r in place_products({"s": [1, 2]}, {})] == ["unplaced"] * 2
    assert pages_used(place_products({"s": list(range(6))}, page(3, 3))) == [3, 3]
    rows = place_products({"s": list(range(6))}, page(4, 2))
    assert pages_used(rows) == [2, 4] and sum(r[3] == "room" for r in rows) == 1
    assert pages_used(place_products({"s": list(range(7))}, page(3, 3, 3))) == [2, 2, 3]
    two = place_products({"a": [1, 2], "b": [3, 4]}, page(3, 3, 3))
    assert len({r[1] for r in two if r[0] in (1, 2)} & {r[1] for r in two if r[0] in (3, 4)}) == 0


def test_allocation_keeps_every_product(spark):
    products = spark.createDataFrame([(f"c{i % 3}", i, f"s{i % 5}", i) for i in range(60)], "catalogue string, product int, section string, ord int")
    pages = spark.createDataFrame([(f"c{i % 2}", i, f"s{i % 4}", i % 4) for i in range(20)], "catalogue string, page int, section string, blocks int")
    got = allocate(products, pages).toPandas()
    assert sorted(got["product"]) == list(range(60))
    assert (got[got.catalogue == "c2"].how == "unplaced").all()
    assert not got[got.how != "unplaced"].duplicated(["catalogue", "page", "place"]).any()


def test_contents_pages_end_with_no_header(spark):
    kinds = ["family", "subfamily", "row", "row", "row", "family", "row", "row"]
    df = spark.createDataFrame([("k", i, kind, str(i)) for i, kind in enumerate(kinds)], "k string, position long, kind string, text string")
    got = [r["contents_page"] for r in contents_pages(df, ["k"], 3).orderBy("position").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 3, 3]


def test_admission_does_not_count_refused_hits(spark):
    recent, decisions = [], []
    for t in (0, 10, 20, 1005, 1012):
        recent, ok, wait = admit(recent, t, 1000, 2)
        decisions.append((ok, wait))
    assert decisions == [(True, 0), (True, 0), (False, 1), (True, 0), (True, 0)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 10, 20, 1005, 1012))], "key long, event_id long, ts_ms long")
    assert [r["admitted"] for r in admissions(rows, 1000, 2).orderBy("event_id").collect()] == [True, True, False, True, True]


def test_circuit(spark):
    state, refused = (0, None), []
    for now, outcome in [(0, "429"), (1, "500"), (2, "429"), (3, "429"), (4, "ok"), (400_000, "ok"), (400_001, "429")]:
        failures, opened, no = trip(*state, now, outcome)
        state = (failures, opened)
        refused.append(no)
    assert refused == [False, False, False, False, True, False, False]
    rows = spark.createDataFrame([(1, i, t, o) for i, (t, o) in enumerate([(0, "429"), (1, "429"), (2, "429"), (3, "ok")])], "key long, event_id long, ts_ms long, outcome string")
    assert [r["refused"] for r in circuit(rows).orderBy("event_id").collect()] == [False, False, False, True]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "k int, v string, o int")
    assert ranking.majority(rows, ["k"], "v", "o").count() == 0
    assert ordered.fill_forward(rows, ["k"], ["o"], "v", "x").count() == 0
