"""Page analytics: slots, sections, kinds, names, blocks, images, overflow. Pages are orders; texts come from the parts on their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import lexicons as L
from pagewright.operators import pages as P
from pagewright.queries import sql
from pagewright.queries.carriers import table

WIDTH, HEIGHT = 500.0, 595.0


def texts(spark, d):
    """Spans with texts: names of parts, with page numbers, leaders and separators planted by the line's numbers."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_name")
    k = F.col("l_partkey") % 7
    text = F.when(k == 0, F.concat("p_name", F.lit(" ... "), F.col("l_linenumber"))).when(k == 1, F.concat(F.lit("p. "), F.col("l_linenumber"))).when(k == 2, F.upper("p_name")).when(k == 3, F.concat("p_name", F.lit(" : "), F.col("l_returnflag"))).otherwise(F.col("p_name"))
    x0, y0 = F.col("l_discount") * 1000, F.col("l_quantity") * 12
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("page"), F.concat_ws("-", F.format_string("%09d", "l_partkey"), F.format_string("%09d", "l_suppkey"), F.format_string("%02d", "l_linenumber"), F.format_string("%04d", F.col("l_quantity").cast("int"))).alias("ord"),
        text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 5 + F.col("l_tax") * 5000).alias("x1"), (y0 + 10).alias("y1"), (F.col("l_linenumber") + 6.0).alias("size"), "l_returnflag",
    )


TEXTS = """(SELECT l_orderkey AS page, printf('%09d-%09d-%02d-%04d', l_partkey, l_suppkey, l_linenumber, l_quantity::INT) AS ord,
  CASE l_partkey % 7 WHEN 0 THEN p_name || ' ... ' || l_linenumber WHEN 1 THEN 'p. ' || l_linenumber WHEN 2 THEN upper(p_name) WHEN 3 THEN p_name || ' : ' || l_returnflag ELSE p_name END AS text,
  l_discount * 1000 AS x0, l_quantity * 12 AS y0, l_discount * 1000 + 5 + l_tax * 5000 AS x1, l_quantity * 12 + 10 AS y1, l_linenumber + 6.0::DOUBLE AS size, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def q_slot_types(spark, d):
    return texts(spark, d).select("page", "ord", P.slot_type(F.col("text"), F.col("size"), WIDTH, HEIGHT).alias("type"))


SLOT = f"""CASE WHEN strlen(trim(text)) >= 6 AND ((size >= 11 AND y0 / {HEIGHT} < 0.25) OR (x1 - x0 > {WIDTH} * 0.55 AND size >= 9 AND y0 / {HEIGHT} < 0.60)) THEN 'section_banner'
  WHEN y1 > {HEIGHT} - 40 AND length(replace(text, ' ', '')) <= 6 AND regexp_full_match(replace(text, ' ', ''), '[0-9/.pP-]+') AND length(regexp_replace(text, '[^0-9]', '', 'g')) BETWEEN 1 AND 4 THEN 'page_number'
  WHEN contains(text, '...') OR contains(text, '. . .') THEN 'toc_entry' WHEN size >= 24 AND y0 < 200 THEN 'toc_title' ELSE 'running_header' END"""


def q_section_labels(spark, d):
    slots = texts(spark, d).withColumn("type", F.when(F.col("l_returnflag") == "R", "section_ribbon").otherwise(P.slot_type(F.col("text"), F.col("size"), WIDTH, HEIGHT)))
    return P.section_labels(slots, banner_min=9.0, name_max=10.0)


LABEL_SQL = f"""
WITH s AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'section_ribbon' ELSE {SLOT} END AS type, trim(text) AS t, regexp_matches(text, '[:=|→·]') OR regexp_matches(text, '\\s[—–]\\s') AS kv FROM {TEXTS}),
p AS (SELECT page, ord, t, CASE
  WHEN type = 'section_banner' AND size >= 9 AND NOT kv AND size > 10 AND length(t) <= 80 AND (length(t) >= 6 OR (length(t) >= 2 AND t = upper(t) AND regexp_matches(t, '[A-ZÀ-Ý]') AND size >= 15)) THEN 1
  WHEN type = 'section_banner' AND length(t) BETWEEN 2 AND 80 AND NOT kv AND t = upper(t) AND regexp_matches(t, '[A-ZÀ-Ý]') AND ((y0 < 50 AND size >= 9) OR (x0 < 30 AND size >= 8)) THEN 2
  WHEN type = 'section_ribbon' AND length(t) BETWEEN 2 AND 80 THEN 3 END AS r FROM s)
SELECT page, t AS section FROM p WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY r, ord) = 1"""


def kind_inputs(spark, d):
    t, n = texts(spark, d), F.col("l_returnflag")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    pages = t.groupBy("page").agg(
        F.count_if(n == "N").alias("n_blocks"), F.count_if((n == "N") & (F.col("size") > 9)).alias("n_refs"), F.sum(F.when(n == "N", F.col("size")).otherwise(0)).alias("n_specs"), F.count_if((n == "N") & (F.col("x0") > 70)).alias("n_images"),
        F.min(F.when(n == "N", F.col("size"))).alias("min_name_size"), F.lit(0).alias("n_tiny_refs"), F.count_if(F.col("text").contains("...")).alias("n_toc_slots"), F.count_if(F.col("text").startswith("p.")).alias("n_page_refs"),
        F.count(F.lit(1)).alias("n_spans"), F.count_if(F.length("text") < 40).alias("n_labels"), F.lit(0).alias("n_vectors"), F.least(F.lit(1.0), F.sum(area) / 9000.0).alias("coverage"), (F.max(area) / 9000.0).alias("largest"),
        F.concat_ws(" | ", F.array_sort(F.collect_list("text"))).alias("text"),
    )
    return pages.withColumn("text", F.when(F.col("page") % 9 == 0, F.concat("text", F.lit(" | Sommaire"))).otherwise(F.col("text"))).withColumn("section", F.when(F.col("page") % 2 == 0, "S"))


def q_page_kinds(spark, d):
    return P.page_kinds(kind_inputs(spark, d)).select("page", "kind", "confidence")


KIND_SQL = f"""
WITH p AS (SELECT page, count(*) FILTER (WHERE l_returnflag = 'N') AS nb, count(*) FILTER (WHERE l_returnflag = 'N' AND size > 9) AS nr, sum(CASE WHEN l_returnflag = 'N' THEN size ELSE 0 END) AS ns,
  count(*) FILTER (WHERE l_returnflag = 'N' AND x0 > 70) AS ni, min(CASE WHEN l_returnflag = 'N' THEN size END) AS mn, count(*) FILTER (WHERE contains(text, '...')) AS nt, count(*) FILTER (WHERE starts_with(text, 'p.')) AS np,
  least(1.0, sum((x1 - x0) * (y1 - y0)) / 9000.0) AS cov, max((x1 - x0) * (y1 - y0)) / 9000.0 AS lar, lower(strip_accents(string_agg(text, ' | ' ORDER BY text))) || CASE WHEN page % 9 = 0 THEN ' | sommaire' ELSE '' END AS t FROM {TEXTS} GROUP BY page),
k AS (SELECT *, nb > 0 AND (cov > 0.5 OR lar > 0.35 OR mn > 24) AND nr = 0 AND ni = 0 AND ns < 3 AS cover, CASE {' '.join(f"WHEN {' OR '.join(f'contains(t, {sql.quote(x)})' for x in v)} THEN {sql.quote(name)}" for name, v in L.PAGE_KEYWORDS.items())} END AS word FROM p)
SELECT page, CASE WHEN nb > 0 AND NOT cover AND NOT (nr = 0 AND ns < 5) THEN 'product' WHEN nt > 0 OR np >= 8 THEN 'toc' WHEN word IS NOT NULL THEN word WHEN page % 2 = 0 AND cov < 0.4 THEN 'intercalaire' ELSE 'identity' END AS kind,
  (CASE WHEN nb > 0 AND NOT cover AND NOT (nr = 0 AND ns < 5) THEN 0.95 WHEN nt > 0 THEN 0.9 WHEN np >= 8 THEN 0.85 WHEN word IS NOT NULL THEN 0.85 WHEN page % 2 = 0 AND cov < 0.4 THEN 0.85 ELSE 0.7 END)::DOUBLE AS confidence FROM k"""


def q_name_blocks(spark, d):
    return P.name_blocks(texts(spark, d).select("page", "ord", "text", "size", "x0", "y0", "x1", "y1"))


def q_main_images(spark, d):
    rows = texts(spark, d).select("page", "ord", "x0", "y0", "x1", (F.col("y0") + 20 + F.col("size") * 8).alias("y1"), F.lit(0.0).alias("top"), F.lit(400.0).alias("bottom"))
    return P.main_images(rows, ["page"], WIDTH, 90.0, 40.0).select("page", "ord", F.round("score", 6).alias("score"))


IMAGE_SQL = f"""
WITH i AS (SELECT page, ord, x0, y0, y0 + 20 + size * 8 AS y1, x1 - x0 AS w, 20 + size * 8 AS h FROM {TEXTS}),
f AS (SELECT page, ord, w * h * (1 - least(0.5, (greatest(w / h, h / w) - 1) * 0.05)) AS score FROM i WHERE x0 < 90 AND y0 >= 0 AND y0 < 400 AND w >= 40 AND h >= 40
  AND NOT (w > {WIDTH} * 0.5 AND h < 80) AND NOT ((h > 360 AND w > {WIDTH} * 0.6) OR (y0 < 2 AND 400 - y1 < 2)))
SELECT page, ord, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) = 1"""


def q_grid_overflow(spark, d):
    pages = texts(spark, d).groupBy("page").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("y0").alias("top"), (F.max("y0") + 50).alias("bottom"))
    return P.overflow_blocks(pages, F.col("n_blocks") + F.col("page") % 4, HEIGHT).withColumn("i", F.col("i").cast("long"))


OVERFLOW_SQL = f"""
WITH p AS (SELECT page, max(y0) AS top, max(y0) + 50 AS bottom FROM {TEXTS} GROUP BY page), n AS (SELECT *, least(floor(({HEIGHT} - 30 - bottom) / 58.0)::BIGINT, page % 4) AS n FROM p)
SELECT page, i, top + i * 58 AS top, bottom + i * 58 AS bottom FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM n WHERE n > 0)"""


def q_ribbons(spark, d):
    return P.ribbons(texts(spark, d), WIDTH, HEIGHT)


def q_page_hash(spark, d):
    """Pages with the same texts in the same order."""
    return P.page_hash(texts(spark, d)).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first_page"))


HASH_SQL = f"""
WITH s AS (SELECT page, trim(text) AS t, row_number() OVER (PARTITION BY page ORDER BY floor(y0 / 0.5), x0, ord) AS i FROM {TEXTS} WHERE trim(text) <> ''),
h AS (SELECT page, sha256(string_agg(t, '|' ORDER BY i)) AS content_hash FROM s WHERE i <= 20 GROUP BY page)
SELECT content_hash, count(*) AS n_pages, min(page) AS first_page FROM h GROUP BY content_hash"""

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_slot_types": f"SELECT page, ord, {SLOT} AS type FROM {TEXTS}",
    "q_section_labels": LABEL_SQL,
    "q_page_kinds": KIND_SQL,
    "q_main_images": IMAGE_SQL,
    "q_grid_overflow": OVERFLOW_SQL,
    "q_page_hash": HASH_SQL,
}
