"""Edits resolved in the rows of their blocks: the same as by looking their targets up, and without zones on the way."""

from compare import DATA
from pyspark.sql import functions as F
from test_blocks import BLOCK, text

from pagewright.operators import intents
from pagewright.queries.catalogue import QUERIES

PRODUCT = "struct<name: string, ref: string, shade: string, image_path: string, new_specs: array<struct<key: string, values: array<string>>>>"


def test_edits_in_their_rows(spark):
    image, specs = (5.0, 5.0, 9.0, 9.0), [(text(0.0, "k"), text(60.0, "v")), (text(1.0, "k2"), None), (None, text(2.0, "v3"))]
    full = ("Évier “²” ½ très long pour sa boîte", "R", "Noir", "a.png", [("K’", ["v’", "1"]), (None, None), ("c", [" x "]), ("d", ["y"])])
    rows = [
        (1, 0, text(0.0, "a"), text(1.0, "r"), text(2.0, "c"), image, specs, full),
        (1, 1, None, None, None, None, None, full),  # no zones
        (1, 2, text(0.0, "a"), text(1.0, "r"), None, image, specs, None),  # no product
        (2, 0, text(0.0, "a"), None, None, image, specs, ("N", "", None, "", [("k", ["v"])])),  # alone on its page
        (3, 4, text(0.0, "a"), None, None, image, specs, full),  # alone, but not the first
        (4, 0, text(0.0, None, None), None, None, image, [], (None, None, None, None, None)),
        (None, 0, text(0.0, "a"), None, None, image, specs, None),
    ]
    both = spark.createDataFrame(rows, f"{BLOCK}, product {PRODUCT}")
    blocks, products = both.drop("product"), both.filter("product IS NOT NULL").select("page", "block", "product.*")
    edits = intents.product_intents(blocks, products).withColumn("id", F.col("block") * 100 + F.col("seq")).withColumn("fill", F.lit(None).cast("string"))
    want = intents.resolved(edits.drop("block", "seq"), intents.page_schema(blocks))
    got = intents.resolved_products(both).withColumn("id", F.col("block") * 100 + F.col("intent")).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("op IS NULL").count() > 3


def test_only_lines_are_exchanged(spark):
    plan = QUERIES["q_resolved_intents"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x.strip() for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 2 and "Join" not in plan and plan.count("FileScan") == 1
