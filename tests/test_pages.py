from pyspark.sql import functions as F

from pagewright.operators import enrichment, pages, profiles


def test_names_merge_with_the_run_before(spark):
    rows = [(1, "ROBINET", 11.0, 50.0, 100.0, 120.0, 111.0), (2, "MURAL ", 11.0, 50.0, 115.0, 110.0, 126.0), (3, "BAC", 11.0, 200.0, 100.2, 240.0, 111.0), (4, "INOX", 11.0, 243.0, 100.0, 280.0, 111.0), (5, "AUTRE", 9.5, 50.0, 127.0, 90.0, 136.0)]
    df = spark.createDataFrame(rows, "o int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    runs = df.agg(pages.merged_names(F.collect_list(F.struct("y0", "x0", "text", "size", "x1", "y1"))).alias("r")).first()["r"]
    assert [r["text"] for r in runs] == ["ROBINET", "BAC INOX", "MURAL", "AUTRE"]


def test_blocks_in_rows_and_columns(spark):
    names = [("A name", 50.0, 100.0), ("B name", 250.0, 100.0), ("C name", 50.0, 300.0), ("D name", 250.0, 301.0)]
    df = spark.createDataFrame([(1, i, t, 11.0, x, y, x + 60, y + 11) for i, (t, x, y) in enumerate(names)] + [(2, 0, "E name", 11.0, 50.0, 100.0, 90.0, 111.0), (2, 1, "F name", 11.0, 50.0, 300.0, 90.0, 311.0)], "page int, ord int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page"], r["name"]): (r["top"], r["bottom"], r["right"]) for r in pages.name_blocks(df).collect()}
    assert got[1, "A name"] == (100.0, 296.0, 250.0) and got[1, "D name"] == (301.0, 565.0, 1e9)
    assert got[2, "E name"] == (100.0, 296.0, 1e9) and got[2, "F name"] == (300.0, 565.0, 1e9)


def test_ribbons():
    assert pages.merge_ribbons([(0, 10, 100, 20), (110, 12, 200, 22), (0, 50, 100, 60), (0, 12, 900, 20)], 500, 500) == [(0, 10, 200, 22), (0, 50, 100, 60), (0, 12, 900, 20)]


def test_continuation_stops_at_a_gap(spark):
    lines = F.array(*[F.struct(F.lit(float(y)).alias("y0"), F.lit(float(y + 8)).alias("y1"), F.lit(t).alias("text")) for y, t in ((20, "b"), (10, "a"), (60, "far"))])
    assert spark.range(1).select(pages.continuation_lines(lines, F.lit(10.0), F.lit(8.0), F.lit(0.0)).alias("x")).first()["x"] == ["a", "b"]


def test_replies(spark):
    texts = ['```json\n{"a": 1}\n```', 'Here: {"a": 2} ok', "[1, 2]", "none", "", '{"broken": [3']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", enrichment.parse_reply(F.col("t")).cast("string").alias("v")).orderBy("i")
    assert [r["v"] for r in df.collect()] == ['{"a":1}', '{"a":2}', "[1,2]", None, None, None]


def test_rules(spark):
    df = spark.createDataFrame([("7 m³/h", "{value} m3/h"), ("60", "{value} cm"), (" ", "{value} cm"), ("x", "fixed"), ("x", None)], "v string, r string")
    assert [r[0] for r in df.select(enrichment.apply_rule(F.col("v"), F.col("r"))).collect()] == ["7 m³/h", "60 cm", "", "fixed", "x"]


def test_tabular_keys(spark):
    lines = [(10.0, "Matiere", "inox"), (30.0, "Longueur", "60 cm"), (50.0, "Garantie", "2 ans"), (70.0, "Contents", "p. 12"), (90.0, "far", None), (110.0, "12,5", "x"), (130.0, "a : b", "c")]
    rows = [(1, f"{i}-{k}", t, 20.0 + i % 2 + k * 150, y) for i, (y, *own) in enumerate(lines) for k, t in enumerate(own) if t]
    got = profiles.tabular_keys(spark.createDataFrame(rows, "page long, ord string, text string, x0 double, y0 double"), 500.0).orderBy("y0").collect()
    assert [r["text"] for r in got] == ["Matiere", "Longueur", "Garantie"]
