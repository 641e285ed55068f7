"""Product table queries: sections, majorities, hierarchy, duplicates, overlays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators.ordered import hierarchy_headers, permute_slots
from pagewright.operators.ranking import balanced_parts, best, even_sample, majority, upper_medians
from pagewright.queries import sql
from pagewright.queries.carriers import table


def q_section_groups(spark, d):
    """Sections of the product table by size, with the first label, the most frequent family and the first row."""
    rows = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", X.normalize_section(F.col("p_brand")).alias("section_key"))
    groups = rows.groupBy("section_key").agg(F.min_by("p_brand", "p_partkey").alias("label"), F.count(F.lit(1)).alias("n_products"), F.min("p_partkey").alias("first_row"))
    family = majority(rows, ["section_key"], "p_type", "p_partkey").select("section_key", F.col("p_type").alias("family"))
    place = F.row_number().over(Window.orderBy(F.desc("n_products"), "first_row"))  # over sections, not products
    return groups.join(family, "section_key", "left").withColumn("position", place.cast("long"))


SECTION_SQL = f"""
WITH p AS (SELECT p_partkey, p_type, p_brand, {sql.section('p_brand')} AS section_key FROM part),
g AS (SELECT section_key, arg_min(p_brand, p_partkey) AS label, count(*) AS n_products, min(p_partkey) AS first_row FROM p GROUP BY section_key),
f AS (SELECT section_key, p_type AS family FROM (SELECT section_key, p_type, count(*) AS n, min(p_partkey) AS o FROM p WHERE trim(p_type) <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY section_key ORDER BY n DESC, o) = 1)
SELECT g.*, f.family, row_number() OVER (ORDER BY n_products DESC, first_row) AS position FROM g LEFT JOIN f USING (section_key)"""


def q_majority_field(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return majority(rows, ["c_nationkey"], "o_orderpriority", "o_orderkey")


def q_category_cardinality(spark, d):
    part = table(spark, d, "part").select("p_type", "p_brand", F.col("p_size").cast("string").alias("p_size"), "p_name")
    counts = part.agg(*[F.count_distinct(F.when(F.trim(c) != "", F.col(c))).alias(c) for c in part.columns])
    long = counts.unpivot([], part.columns, "col", "n_distinct").filter((F.col("n_distinct") >= 1) & (F.col("n_distinct") <= 200))
    return long.withColumn("level", F.row_number().over(Window.orderBy("n_distinct", "col")).cast("long"))


def q_upper_median(spark, d):
    return upper_medians(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


def q_dup_refs(spark, d):
    part = table(spark, d, "part")
    w = Window.partitionBy("p_name")
    return part.select("p_partkey", "p_name", F.count(F.lit(1)).over(w).alias("n_rows"), F.min("p_partkey").over(w).alias("first_row")).filter("n_rows > 1")


def q_balanced_split(spark, d):
    rows = balanced_parts(table(spark, d, "part"), ["p_brand"], [F.col("p_partkey")], 7)
    return rows.groupBy("p_brand", "part").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_row"))


def q_hierarchy_headers(spark, d):
    part = table(spark, d, "part").withColumn("family", F.when(F.col("p_size") % 10 != 0, F.col("p_type")))
    return hierarchy_headers(part.withColumn("label", F.col("p_partkey").cast("string")), ["p_brand"], ["p_type", "p_size", "p_partkey"], "family", "p_name", "label")


HEADERS_SQL = """
WITH p AS (SELECT p_brand, p_type, p_size, p_partkey, p_name AS s, CASE WHEN p_size % 10 <> 0 THEN p_type END AS f, row_number() OVER w AS i,
  lag(CASE WHEN p_size % 10 <> 0 THEN p_type END) OVER w AS before FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_type, p_size, p_partkey)),
n AS (SELECT *, i = 1 OR f IS DISTINCT FROM before AS fresh FROM p),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY p_brand ORDER BY i) AS run FROM n),
k AS (SELECT *, lag(s) OVER (PARTITION BY p_brand, run ORDER BY i) AS shown FROM r),
a AS (SELECT p_brand, i, 0 AS o, 'family' AS kind, coalesce(f, 'Autres') AS text FROM k WHERE fresh AND (f IS NOT NULL OR i > 1)
  UNION ALL SELECT p_brand, i, 1, 'subfamily', s FROM k WHERE s IS DISTINCT FROM shown
  UNION ALL SELECT p_brand, i, 2, 'row', p_partkey::VARCHAR FROM k)
SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY i, o) AS position, kind, text FROM a"""


def q_renumber_slots(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_partkey", "p_type", "p_size")
    return permute_slots(part, ["p_brand"], "p_partkey", F.col("p_size") % 3 != 0, [F.col("p_type"), F.col("p_size"), F.col("p_partkey")]).withColumn("place", F.col("place").cast("long"))


SLOTS_SQL = """
WITH p AS (SELECT p_brand, p_partkey, p_type, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS o FROM part),
m AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY o) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size, p_partkey) AS b FROM p WHERE p_size % 3 <> 0)
SELECT x.p_brand, x.p_partkey, x.p_type, x.p_size, y.o AS place FROM m x JOIN m y ON x.p_brand = y.p_brand AND x.b = y.a
UNION ALL SELECT p_brand, p_partkey, p_type, p_size, o FROM p WHERE p_size % 3 = 0"""


def q_toc_first_page(spark, d):
    """Final page of each customer's first order, by an order's own number."""
    orders = table(spark, d, "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("source_page"))
    final = orders.select(F.col("o_orderkey").alias("source_page"), F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey")).cast("long").alias("final_page"), "o_orderstatus")
    return first.join(final, "source_page", "left").select("o_custkey", "source_page", "o_orderstatus", "final_page")


TOC_SQL = """
WITH f AS (SELECT o_custkey, min(o_orderkey) AS source_page FROM orders GROUP BY 1), n AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS final_page FROM orders)
SELECT f.o_custkey, f.source_page, n.o_orderstatus, n.final_page FROM f LEFT JOIN n ON n.o_orderkey = f.source_page"""


def q_drop_reasons(spark, d):
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    rows = table(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    reason = F.when(F.col("n").isNull(), "no_order").when(F.col("c_acctbal") < 0, "negative_balance").when(F.col("total") < 500_000, "too_small").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


REASON_SQL = """
WITH s AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT CASE WHEN s.n IS NULL THEN 'no_order' WHEN c_acctbal < 0 THEN 'negative_balance' WHEN total < 500000 THEN 'too_small' ELSE 'kept' END AS reason, count(*) AS n
FROM customer LEFT JOIN s ON c_custkey = o_custkey GROUP BY 1"""


def q_corrections(spark, d):
    """Labels laid over documents: the last one counts and makes the kind certain."""
    last = table(spark, d, "labels").groupBy("doc_id").agg(F.max_by("quality", "toxic").alias("fix"))
    return table(spark, d, "documents").join(last, "doc_id", "left").select(
        "doc_id", F.coalesce(F.when(F.col("fix") == 1, "good").when(F.col("fix") == 0, "bad"), F.col("lang")).alias("kind"), F.when(F.col("fix").isNotNull(), 1.0).otherwise(0.7).alias("confidence")
    )


CORRECTION_SQL = """
WITH l AS (SELECT doc_id, arg_max(quality, toxic) AS fix FROM labels GROUP BY 1)
SELECT d.doc_id, coalesce(CASE fix WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, lang) AS kind, (CASE WHEN fix IS NOT NULL THEN 1.0 ELSE 0.7 END)::DOUBLE AS confidence FROM documents d LEFT JOIN l USING (doc_id)"""


def q_orphans(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def q_even_sample(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    inner = even_sample(docs, ["source"], [F.col("doc_id")], 8).withColumn("rule", F.lit("middles"))
    return inner.unionByName(even_sample(docs, ["source"], [F.col("doc_id")], 8, ends=True).withColumn("rule", F.lit("ends")))


SAMPLE_SQL = """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, 'middles' AS rule FROM r WHERE n <= 8 OR i IN (SELECT floor((k + 0.5) * n / 8)::BIGINT FROM range(8) t(k))
UNION ALL SELECT source, doc_id, 'ends' FROM r WHERE n <= 8 OR i IN (SELECT floor(k * (n - 1) / 7 + 0.5)::BIGINT FROM range(8) t(k))"""


def q_plan_filter(spark, d):
    """Turns of a conversation from its first to its last assistant turn, and the others by rule."""
    w = Window.partitionBy("conv_id")
    inside = F.col("role") == "assistant"
    rows = table(spark, d, "conversations").withColumn("lo", F.min(F.when(inside, F.col("turn"))).over(w)).withColumn("hi", F.max(F.when(inside, F.col("turn"))).over(w))
    zone = F.when(F.col("lo").isNull(), "none").when(F.col("turn") < F.col("lo"), "intro").when(F.col("turn") > F.col("hi"), "outro").otherwise("zone")
    keep = F.when(zone == "zone", True).otherwise(F.col("role") != "system")
    return rows.select("conv_id", "turn", zone.alias("zone"), keep.alias("keep"))


PLAN_SQL = """
WITH r AS (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS lo, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS hi FROM conversations),
z AS (SELECT *, CASE WHEN lo IS NULL THEN 'none' WHEN turn < lo THEN 'intro' WHEN turn > hi THEN 'outro' ELSE 'zone' END AS zone FROM r)
SELECT conv_id, turn, zone, CASE WHEN zone = 'zone' THEN true ELSE role <> 'system' END AS keep FROM z"""


def q_spec_unpivot(spark, d):
    """Spec columns as rows, in header order, without values that say nothing."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("101 Taille"), F.col("p_type").alias("100 Matiere"), F.when(F.col("p_size") % 5 == 0, "N/A.").otherwise(F.col("p_brand")).alias("102 Marque"))
    long = part.unpivot(["p_partkey"], ["101 Taille", "100 Matiere", "102 Marque"], "header", "raw")
    return long.select("p_partkey", X.humanize_key(F.col("header")).alias("spec_key"), X.clean_value(F.col("raw")).alias("spec_value")).filter("spec_value IS NOT NULL")


UNPIVOT_SQL = """
SELECT p_partkey, 'TAILLE :' AS spec_key, p_size::VARCHAR AS spec_value FROM part WHERE p_size <> 0 UNION ALL SELECT p_partkey, 'MATIÈRE :', p_type FROM part
UNION ALL SELECT p_partkey, 'MARQUE :', p_brand FROM part WHERE p_size % 5 <> 0"""


def q_union_products(spark, d):
    """Products of several files in one table; what a file lacks is null; the first file counts for a reference in several."""
    part = table(spark, d, "part")
    a = part.filter(F.col("p_size") % 2 == 0).select(F.col("p_name").alias("name"), F.col("p_brand").alias("section"), "p_partkey", F.lit(1).alias("file"))
    b = part.filter(F.col("p_size") % 3 == 0).select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), "p_partkey", F.lit(2).alias("file"))
    return best(a.unionByName(b, allowMissingColumns=True), ["p_partkey"], [F.asc("file")])


UNION_SQL = """
WITH u AS (SELECT p_name AS name, p_brand AS section, p_partkey, 1 AS file, NULL::DOUBLE AS price FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_name, NULL, p_partkey, 2, p_retailprice FROM part WHERE p_size % 3 = 0)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY file) = 1"""


def q_set_operations(spark, d):
    """Customers with orders, without, and those both in the building segment and with a finished order."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    ordered = table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    building = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    finished = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return customers.exceptAll(ordered).withColumn("kind", F.lit("without")).unionByName(building.intersect(finished).withColumn("kind", F.lit("both")))


SET_SQL = """
SELECT c_custkey AS id, 'without' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT * FROM (SELECT c_custkey AS id, 'both' AS kind FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'F')"""

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_section_groups": SECTION_SQL,
    "q_majority_field": "SELECT c_nationkey, o_orderpriority, n FROM (SELECT c_nationkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE trim(o_orderpriority) <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, o) = 1",
    "q_category_cardinality": "WITH c AS (SELECT 'p_type' AS col, count(DISTINCT p_type) AS n_distinct FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_name', count(DISTINCT nullif(trim(p_name), '')) FROM part) SELECT col, n_distinct, row_number() OVER (ORDER BY n_distinct, col) AS level FROM c WHERE n_distinct BETWEEN 1 AND 200",
    "q_upper_median": "SELECT l_returnflag, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "q_dup_refs": "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n_rows, min(p_partkey) OVER (PARTITION BY p_name) AS first_row FROM part QUALIFY n_rows > 1",
    "q_balanced_split": "SELECT p_brand, part::INT AS part, count(*) AS n, min(p_partkey) AS first_row FROM (SELECT p_brand, p_partkey, ntile(7) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS part FROM part) GROUP BY 1, 2",
    "q_hierarchy_headers": HEADERS_SQL,
    "q_renumber_slots": SLOTS_SQL,
    "q_toc_first_page": TOC_SQL,
    "q_drop_reasons": REASON_SQL,
    "q_corrections": CORRECTION_SQL,
    "q_orphans": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "q_even_sample": SAMPLE_SQL,
    "q_plan_filter": PLAN_SQL,
    "q_spec_unpivot": UNPIVOT_SQL,
    "q_union_products": UNION_SQL,
    "q_set_operations": SET_SQL,
}
