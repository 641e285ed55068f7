import pytest
from pyspark.sql import functions as F

from pagewright.functions import reflow as R
from pagewright.operators import adapter, intents, zones


def test_breaks_at_the_best_place():
    assert R.split_in_two("Court", 200, 12) == ("Court", "", True) and R.split_in_two("", 100, 12) == ("", "", True)
    assert R.split_in_two("Inox brossé, finition mate", 80, 12) == ("Inox brossé", "finition mate", True)
    assert R.split_in_two("coulissant et inclinable", 70, 12) == ("coulissant", "et inclinable", True)
    assert R.split_in_two("rouge ou bleu marine", 50, 12)[1].startswith("ou")
    assert R.split_in_two("option1; option2 et option3", 60, 12)[0] == "option1"
    assert R.split_in_two("aaa bbb ccc ddd eee", 30, 12) == ("aaa", "bbb ccc ddd eee", False)
    assert R.split_in_two("Incassable", 30, 12) == ("Inca", "ssable", False)


def test_ends_of_lines():
    assert [R.clean_end(x) for x in ("texte ,", "texte;", "texte-", "mitigeur et", "longueurs à", "finition de", "Mitigeur thermostatique")] == ["texte", "texte", "texte", "mitigeur", "longueurs", "finition", "Mitigeur thermostatique"]


def tries(text, room, size, least, lines, step=0.5):
    """All that fits, by looking at every way to break the words at every size."""
    words = text.split()

    def greedy(at):
        out = [[words[0]]]
        for w in words[1:]:
            if R.width(" ".join([*out[-1], w]), at) <= room:
                out[-1].append(w)
            else:
                out.append([w])
        return [" ".join(x) for x in out]

    now = size
    while now >= least:
        out = greedy(now)
        if len(out) <= lines and all(R.width(x, now) <= room for x in out):
            return out, now
        now -= step
    return None


@pytest.mark.parametrize("text", ["Hi", "Mitigeur cuisine encastre ALMA", "Mitigeur cuisine encastre ALMA 360 rotation thermostatique premium", "A B C D E F G H I J K L M", "Incompressible" * 4, "Lorem ipsum " * 20])
def test_fits(text):
    lines, size, how = R.fitted(text, 120.0, 14.0, 10.0, 2)
    want = tries(text, 120.0, 14.0, 10.0, 2)
    if want:
        assert (lines, size) == want and how != "truncated"
    else:
        assert how == "truncated" and size == 10.0 and len(lines) <= 2 and lines[-1].endswith("…") and R.width(lines[-1], 10.0) <= 120


def test_cuts_with_an_ellipsis():
    assert R.shortened("Hi", 200, 12) == "Hi" and R.shortened("Lorem ipsum", 1, 12) == "…"
    out = R.shortened("Lorem ipsum dolor, sit amet", 100, 12)
    assert out == "Lorem ipsum…" and R.width(out, 12) <= 100
    assert R.letters_wrapped("x" * 45 + " ab cd", 10, 9) == ["x" * 20, "x" * 20, "x" * 5, "ab cd"]


def test_columns_take_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "Mitigeur cuisine"), (3, "")], "i int, t string")
    got = {r["i"]: r for r in df.select("i", R.fit_lines(F.col("t"), 60.0, 12.0, 8.0, 2).alias("f"), R.split_lines(F.col("t"), 60.0, 12.0).alias("s"), R.shorten(F.col("t"), 60.0, 12.0).alias("c")).collect()}
    assert got[1]["f"]["lines"] == [""] and got[1]["s"]["clean"] and got[1]["c"] is None and got[2]["f"]["lines"] == ["Mitigeur", "cuisine"] and got[3]["c"] == ""


def test_zones_of_blocks(spark):
    rows = [(1, 0, 100.0, 200.0, 50.0, 200.0), (1, 1, 220.0, 300.0, 50.0, 30.0), (1, 2, 305.0, 350.0, 50.0, 60.0), (2, 0, 2.0, 580.0, 10.0, 20.0)]
    got = {(r["page"], r["block"]): (r["x0"], r["y0"], r["x1"], r["y1"]) for r in zones.block_zones(spark.createDataFrame(rows, "page int, block int, top double, bottom double, name_x0 double, specs_x0 double"), 400.0, 595.0, 40.0).collect()}
    assert got == {(1, 0): (46.0, 88.0, 360.0, 204.0), (1, 1): (26.0, 211.0, 360.0, 304.0), (1, 2): (46.0, 301.0, 360.0, 565.0), (2, 0): (6.0, -2.0, 360.0, 584.0)}


TEXT = "struct<box: struct<x0: double, y0: double, x1: double, y1: double>, text: string, size: double, font: string, color: string>"
BLOCK = f"page int, block int, title {TEXT}, reference {TEXT}, color {TEXT}, image struct<x0: double, y0: double, x1: double, y1: double>, specs array<struct<key: {TEXT}, value: {TEXT}>>"


def text(x, t, size=10.0):
    return ((x, 0.0, x + 50.0, 10.0), t, size, "F", "#111111")


def test_edits_become_operations(spark):
    blocks = spark.createDataFrame([(3, 0, text(0.0, "Old"), None, None, (5.0, 5.0, 9.0, 9.0), [(text(0.0, "k"), text(60.0, "v")), (text(1.0, "k2"), None)])], BLOCK)
    schema = intents.page_schema(blocks)
    targets = {r["target"]: (r["text"], r["is_text"]) for r in schema.collect()}
    assert targets["page_3.title"] == ("Old", True) and targets["page_3.product_0.specs_block.item_1.value"] == ("", True) and targets["page_3.image_main"] == (None, False)
    asked = [("replace_text", "page_3.title", "N" * 10, None, None, None, None), ("replace_text", "page_3.image_main", "x", None, None, None, None), ("swap_image", "page_3.image_main", None, None, None, "a.png", None)]
    asked += [("update_spec", "page_3.specs_block.item_0", None, "K", "V", None, None), ("update_spec", "page_3.specs_block.item_7", None, "K", "V", None, None), ("set_color", "page_3.title", None, None, None, None, "#ff0000"), ("remove_element", "page_3.specs_block", None, None, None, None, None), ("replace_text", "page_9.title", "x", None, None, None, None)]
    rows = spark.createDataFrame([(3, i, *a) for i, a in enumerate(asked)], "page int, id int, op string, target string, text string, key string, value string, image_path string, fill string")
    got = {}
    for r in intents.resolved(rows, schema).orderBy("id", "seq").collect():
        got.setdefault(r["id"], []).append((r["op"], r["box"] and tuple(r["box"]), r["text"] or r["image_path"] or r["reason"], r["color"]))
    assert got[0] == [("erase_rect", (-2.0, -2.0, 69.0, 12.0), None, None), ("insert_text", (0.0, 0.0, 50.0, 10.0), "N" * 10, "#111111")]
    assert got[1] == [(None, None, "not a text", None)] and got[4] == got[7] == [(None, None, "no such target", None)]
    assert got[2] == [("erase_rect", (3.0, 3.0, 11.0, 11.0), None, None), ("draw_image", (5.0, 5.0, 9.0, 9.0), "a.png", None)]
    assert [x[0] for x in got[3]] == ["erase_rect", "insert_text"] * 2 and [x[2] for x in got[3]][1::2] == ["K", "V"]
    assert got[5][1][2:] == ("Old", "#ff0000") and got[6] == [("erase_rect", (-2.0, -2.0, 112.0, 12.0), None, None)]


def test_turns_of_a_loop(spark):
    def runs(rows, **k):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "turn int, n_intents int, n_ops int, cost double, same boolean")
        return [r["runs"] for r in intents.loop_ends(df, **k).orderBy("turn").collect()]

    assert runs([(3, 2, 0.1, False)] * 4) == [True, True, False, False]
    assert runs([(0, 0, 0.1, False), (3, 2, 0.1, False)]) == [True, False] and runs([(3, 0, 0.1, False), (3, 2, 0.1, False)]) == [True, False]
    assert runs([(3, 2, 1.0, False), (3, 2, 0.1, False)]) == [True, False]
    assert runs([(3, 2, 0.1, False), (3, 2, 0.1, True), (3, 2, 0.1, False)], most=5) == [True, True, False]


def test_products_from_cells(spark):
    headers = ["Désignation", "Référence", "EAN", "Coloris", "Photo", "Libellé famille", "Longueur", "Stock", "Matière", "538 Poids"]
    values = [
        ["Évier inox", "R1", "1234567890123", "Gris", "http://x/a/evier.JPG?v=2", "Éviers", "80 cm", "5", "non", "3 kg"],
        ["Bac", "R2", "99", None, None, "Bacs", "n/a", "1", "Grès", ""],
        ["", "R2", "", "", "", "", "", "", "", ""],
        ["", "", "", "", "", "", "", "7", "", ""],
    ]
    cells = spark.createDataFrame([("t", i, j, h, v) for i, row in enumerate(values) for j, (h, v) in enumerate(zip(headers, row, strict=True))], "path string, row_idx int, col_idx int, header string, value string")
    roles = adapter.column_roles(cells.select("path", "col_idx", "header").distinct())
    assert {r["role"]: r["header"] for r in roles.collect()} == {"name": "Désignation", "sku": "Référence", "color": "Coloris", "image": "Photo", "section": "Libellé famille", "family": "Libellé famille"}
    products = adapter.products(cells, roles, [("sinks", ["evier"])])
    got = {r["row_idx"]: r for r in products.collect()}
    assert set(got) == {0, 1, 2}
    assert [(s["key"], s["value"]) for s in got[0]["specs"]] == [("LONGUEUR :", "80 cm"), ("POIDS :", "3 kg")] and [(s["key"], s["value"]) for s in got[1]["specs"]] == [("MATIÈRE :", "Grès")]
    assert got[0]["family"] == "sinks" and got[1]["family"] == "bacs" and got[0]["identifiers"] == ["1234567890123"] and got[2]["name"] is None
    names = adapter.asset_names(products)
    assert sorted((r["row_idx"], r["source_rank"], r["candidate"]) for r in names.collect()) == [(0, 0, "evier"), (1, 2, "Bac")]
    assets = spark.createDataFrame([("evier_2", 1), ("bac", 2)], "asset string, asset_ord int")
    best = adapter.best_assets(names, assets)
    assert {r["row_idx"]: (r["asset"], r["tier"]) for r in best.collect()} == {0: ("evier_2", 3), 1: ("bac", 1)}
    assert {(r["warning"], r["n"], r["detail"]) for r in adapter.warnings(products, best).collect()} == {("nameless", 1, None), ("same reference", 1, "R2"), ("ask for assets", 1, None)}
