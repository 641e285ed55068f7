"""Plans of catalogues: allocation, contents, grids, drawing order. A brand is a catalogue, its types are the sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators.ordered import hierarchy_headers
from pagewright.plans.allocate import allocate, dropped_pages, page_richness
from pagewright.plans.assemble import contents_pages, drawing_order, paginate, plan_documents, technical_grid
from pagewright.queries import sql
from pagewright.queries.carriers import spans, table


def catalogue(spark, d):
    part = table(spark, d, "part")
    products = part.select(F.col("p_brand").alias("catalogue"), F.col("p_partkey").alias("product"), F.col("p_type").alias("section"), F.col("p_partkey").alias("ord"))
    pages = part.filter("p_size % 3 = 0").select(F.col("p_brand").alias("catalogue"), F.col("p_partkey").alias("page"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("section"), (F.col("p_size") % 4 + 1).alias("blocks"))
    return products, pages


def q_alloc(spark, d):
    return allocate(*catalogue(spark, d))


def q_alloc_overflow(spark, d):
    return allocate(*catalogue(spark, d), overflow=True)


def page_blocks(spark, d):
    part = table(spark, d, "part").filter("p_size % 3 = 0").select(F.col("p_brand").alias("catalogue"), F.col("p_partkey").alias("page"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 4)).alias("i"))
    return part.select("catalogue", "page", ((F.col("page") + F.col("i")) % 9).alias("n_specs"), ((F.col("page") * 3 + F.col("i")) % 4 == 0).alias("has_image"), ((F.col("page") + F.col("i")) % 3 == 0).alias("has_ref"))


def q_page_richness(spark, d):
    return page_richness(page_blocks(spark, d)).select("catalogue", "page", F.round("richness", 9).alias("richness"))


RICH_SQL = """
WITH b AS (SELECT p_brand AS catalogue, p_partkey AS page, unnest(generate_series(0, p_size % 4)) AS i FROM part WHERE p_size % 3 = 0)
SELECT catalogue, page, round(least(1, count(*) / 3) * 0.3 + least(1, avg((page + i) % 9) / 5) * 0.3 + avg(((page * 3 + i) % 4 = 0)::INT) * 0.2 + avg(((page + i) % 3 = 0)::INT) * 0.2, 9) AS richness FROM b GROUP BY 1, 2"""


def q_alloc_rich(spark, d):
    products, pages = catalogue(spark, d)
    return allocate(products, pages.join(page_richness(page_blocks(spark, d)), ["catalogue", "page"]), by_richness=True)


def q_dropped_pages(spark, d):
    products, pages = catalogue(spark, d)
    return dropped_pages(pages, allocate(products, pages), products)


def q_paginate(spark, d):
    return paginate(table(spark, d, "part").select("p_brand", "p_type", "p_partkey"), ["p_brand"], "p_type", "p_partkey", 6)


PAGINATE_SQL = """
WITH p AS (SELECT p_brand, p_type, p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS f, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_brand, p_type, p_partkey, (i % 6)::INT AS place, dense_rank() OVER (PARTITION BY p_brand ORDER BY f, i // 6) AS page FROM p"""


def q_technical_grid(spark, d):
    """Parts with a supplier's order as technical sheets, on a grid."""
    part = table(spark, d, "part").join(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return technical_grid(part.select("p_brand", "p_partkey"), ["p_brand"], "p_partkey")


GRID_SQL = """
WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem))
SELECT p_brand, p_partkey, i // 6 AS grid_page, (i % 6 // 2)::INT AS grid_row, (i % 2)::INT AS grid_col FROM p"""


def operations(spark, d):
    op = F.when(F.col("font") == "R", "erase_rect").when(F.col("font") == "N", "insert_text").otherwise("draw_rect")
    return spans(spark, d).select(F.col("page").alias("page_ord"), F.col("ord").alias("op_ord"), op.alias("op"), (F.col("size") > 11).alias("no_erase"))


def q_drawing_order(spark, d):
    return drawing_order(operations(spark, d)).select("page_ord", "op_ord", "op", "pass", "seq")


DRAW_SQL = f"""
WITH o AS (SELECT page AS page_ord, ord AS op_ord, CASE font WHEN 'R' THEN 'erase_rect' WHEN 'N' THEN 'insert_text' ELSE 'draw_rect' END AS op, size > 11 AS no_erase FROM {sql.SPANS}),
p AS (SELECT page_ord, op_ord, op, unnest(CASE WHEN op = 'erase_rect' THEN [1] WHEN op = 'insert_text' AND NOT no_erase THEN [1, 2] ELSE [2] END) AS pass FROM o)
SELECT page_ord, op_ord, op, pass, row_number() OVER (PARTITION BY page_ord ORDER BY pass, op_ord) AS seq FROM p"""


def q_toc_chunk(spark, d):
    part = table(spark, d, "part").withColumn("label", F.col("p_partkey").cast("string"))
    return contents_pages(hierarchy_headers(part, ["p_brand"], ["p_type", "p_size", "p_partkey"], "p_type", "p_name", "label"), ["p_brand"], 12)


def q_plan_documents(spark, d):
    ops = operations(spark, d).withColumn("text", F.concat_ws("-", "page_ord", "op_ord")).withColumn("catalogue", F.col("page_ord") % 50)
    return plan_documents(ops, ["catalogue"])


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
PLAN_SQL = f"""
WITH o AS (SELECT page AS page_ord, ord AS op_ord, CASE font WHEN 'R' THEN 'erase_rect' WHEN 'N' THEN 'insert_text' ELSE 'draw_rect' END AS op, page || '-' || ord AS text FROM {sql.SPANS}),
p AS (SELECT page_ord, list({{'op_ord': op_ord, 'op': op, 'text': text}} ORDER BY op_ord) AS operations FROM o GROUP BY 1)
SELECT page_ord % 50 AS catalogue, to_json({{'version': 1, 'pages': list({{'page_ord': page_ord, 'operations': operations}} ORDER BY page_ord), 'stats': {{'n_operations': sum(len(operations))::BIGINT, 'n_pages': count(*)}}}})::VARCHAR AS plan FROM p GROUP BY 1"""

ORACLES = {"q_page_richness": RICH_SQL, "q_plan_documents": PLAN_SQL, "q_paginate": PAGINATE_SQL, "q_technical_grid": GRID_SQL, "q_drawing_order": DRAW_SQL}
