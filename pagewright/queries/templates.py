"""Templates as a whole: dividers, contents, profiles, signatures, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import profiles as R
from pagewright.operators.ordered import hierarchy_headers
from pagewright.plans.assemble import contents_pages
from pagewright.queries import sql
from pagewright.queries.carriers import spans, table
from pagewright.queries.pages import HEIGHT, TEXTS, WIDTH, texts


def q_pure_dividers(spark, d):
    pages = table(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("page"), F.when(F.col("o_orderstatus") == "F", "intercalaire").otherwise("product").alias("kind"), F.lit(900).alias("n_pages")).groupBy("page").agg(F.min("kind").alias("kind"), F.first("n_pages").alias("n_pages"))
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("page"), F.when(F.col("l_linenumber") == 1, (F.col("l_partkey") + 10_000_000).cast("string")).when(F.col("l_linenumber") == 2, "Garantie 2 ans").when(F.col("l_linenumber") == 3, "2024").when(F.col("l_linenumber") == 4, "28062024").otherwise("x").alias("text")).filter("page % 3 <> 0 OR text = '2024'")
    return R.pure_dividers(pages, lines)


DIVIDER_SQL = r"""
WITH p AS (SELECT o_orderkey % 1000 AS page, min(CASE o_orderstatus WHEN 'F' THEN 'intercalaire' ELSE 'product' END) AS kind FROM orders GROUP BY 1),
l AS (SELECT l_orderkey % 1000 AS page, CASE l_linenumber WHEN 1 THEN (l_partkey + 10000000)::VARCHAR WHEN 2 THEN 'Garantie 2 ans' WHEN 3 THEN '2024' WHEN 4 THEN '28062024' ELSE 'x' END AS t FROM lineitem),
k AS (SELECT page, count(*) FILTER (WHERE length(t) > 1) AS n, count(*) FILTER (WHERE regexp_matches(t, '^[0-9]{8}$') AND NOT regexp_matches(t, '^(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])(19|20)\d{2}$') OR contains(t, 'Garantie')) AS s FROM l WHERE page % 3 <> 0 OR t = '2024' GROUP BY 1)
SELECT p.page FROM p LEFT JOIN k USING (page) WHERE kind = 'intercalaire' AND p.page BETWEEN 5 AND 894 AND coalesce(n, 0) <= 30 AND coalesce(s, 0) < 2"""


def q_page_ribbons(spark, d):
    return texts(spark, d).filter(R.is_ribbon(WIDTH, HEIGHT)).select("page", "ord")


RIBBON = f"""SELECT page, ord FROM {{}} WHERE length(trim(text)) >= 3 AND size >= 8 AND ((y1 - y0 > x1 - x0 AND (x1 < 40 OR x0 > {WIDTH} - 40)) OR
  (x1 - x0 > y1 - y0 AND length(trim(text)) <= 40 AND size >= 12 AND x1 - x0 >= {WIDTH} * 0.3 AND (y1 < 60 OR y0 > {HEIGHT} - 60)))"""


def q_tabular_keys(spark, d):
    rows = texts(spark, d).withColumn("y0", F.floor(F.col("y0") / 60) * 60.0).withColumn("x0", F.col("x0") * 5)
    return R.tabular_keys(rows.withColumn("page", F.col("page") % 3000), WIDTH)


def q_best_contents(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("page"), F.explode(F.split("text", "\n", -1)).alias("label"))
    return R.best_contents(docs.withColumn("is_ref", F.length("label") % 3 == 0), ["source"]).withColumn("score", F.round("score", 6))


CONTENTS_SQL = """
WITH l AS (SELECT source, doc_id AS page, unnest(string_split(text, chr(10))) AS label FROM documents),
p AS (SELECT source, page, count(*) FILTER (WHERE length(label) % 3 = 0) AS refs, count(*) AS n, avg(length(trim(label))) AS m FROM l GROUP BY 1, 2),
s AS (SELECT source, page, n * least(m, 25.0) AS score FROM p WHERE refs >= 3 AND m >= 8)
SELECT source, page, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, page) = 1"""


def q_best_profile(spark, d):
    part = table(spark, d, "part").select("p_name", "p_partkey", F.when(F.col("p_partkey") % 97 == 0, F.col("p_retailprice") * 4).otherwise(F.col("p_retailprice")).alias("x_max"))
    return R.best_profile(part.withColumn("template", F.col("p_partkey") % 150).drop("p_name"), ["template"], "x_max", "p_partkey")


PROFILE_SQL = """
WITH p AS (SELECT p_partkey, p_partkey % 150 AS template, CASE WHEN p_partkey % 97 = 0 THEN p_retailprice * 4 ELSE p_retailprice END AS x_max FROM part),
r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY template ORDER BY x_max, p_partkey) AS r, max(x_max) OVER w AS top FROM p WINDOW w AS (PARTITION BY template)),
m AS (SELECT *, max(CASE WHEN r = n // 2 + 1 THEN x_max END) OVER w AS med, count(*) FILTER (WHERE x_max >= top * 0.9) OVER w AS near FROM r WINDOW w AS (PARTITION BY template))
SELECT p_partkey, template, x_max FROM m WHERE NOT (n >= 3 AND top > med * 1.5 AND near = 1 AND x_max = top) QUALIFY row_number() OVER (PARTITION BY template ORDER BY x_max DESC, p_partkey) = 1"""


def q_profile_signature(spark, d):
    return R.signatures(spans(spark, d).withColumn("template", F.col("page") % 300), ["template"])


SIGNATURE_SQL = f"""
WITH s AS (SELECT *, page % 300 AS template, dense_rank() OVER (PARTITION BY page % 300 ORDER BY page) AS p, row_number() OVER (PARTITION BY page ORDER BY ord) AS i FROM {sql.SPANS}),
g AS (SELECT template, p, count(*) || ':' || coalesce(string_agg(font || '/' || printf('%.1f', size), ',' ORDER BY i) FILTER (WHERE i <= 10), '') || ':[' ||
  array_to_string(list_transform(list_reverse_sort(list(DISTINCT floor(size * 2 + 0.5) / 2) FILTER (WHERE i <= 50))[:5], lambda x: printf('%.1f', x)), ',') || ']' AS t FROM s WHERE p <= 6 GROUP BY 1, 2)
SELECT g.template, 'n=' || n.n || '|' || string_agg(t, '|' ORDER BY p) AS signature FROM g JOIN (SELECT template, max(p) AS n FROM s GROUP BY 1) n ON n.template = g.template GROUP BY g.template, n.n"""


def q_contents_offsets(spark, d):
    """Heights of contents items, on the pages that a page's number of lines gives."""
    part = table(spark, d, "part").withColumn("label", F.col("p_partkey").cast("string"))
    pages = contents_pages(hierarchy_headers(part, ["p_brand"], ["p_type", "p_size", "p_partkey"], "p_type", "p_name", "label"), ["p_brand"], 12)
    return R.contents_offsets(pages, ["p_brand"], 120.0, 18.0)


def q_layout_specs(spark, d):
    specs = F.array(F.struct(F.concat("p_type", F.lit(" : ")).alias("key"), F.array("p_brand", "p_name").alias("values")), F.struct(F.lit("EMPTY :").alias("key"), F.array().cast("array<string>").alias("values")), F.struct(F.lit("SIZE").alias("key"), F.array(F.col("p_size").cast("string")).alias("values")))
    return table(spark, d, "part").select("p_partkey", F.explode(R.layout_specs(specs)).alias("s")).select("p_partkey", "s.key", "s.value")


def q_safe_issues(spark, d):
    replies = table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("page"), F.when(F.col("event_id") % 3 == 0, "critical").when(F.col("event_id") % 3 == 1, "minor").otherwise("awful").alias("severity"), F.when(F.col("event_type") == "view", "overlap").otherwise(F.col("event_type")).alias("category"), F.when(F.col("event_id") % 7 != 0, "text").alias("description"))
    pages = table(spark, d, "nation").filter("n_nationkey BETWEEN 3 AND 14").select(F.col("n_nationkey").cast("long").alias("final_page"), (F.col("n_nationkey") * 2).alias("source_page"), F.col("n_nationkey").alias("sample_ord"))
    return R.safe_issues(replies, pages).select("event_id", "final_page", "source_page", "severity", "category")


ISSUE_SQL = """
SELECT event_id, CASE WHEN user_id % 20 BETWEEN 3 AND 14 THEN user_id % 20 ELSE 3 END AS final_page, (CASE WHEN user_id % 20 BETWEEN 3 AND 14 THEN user_id % 20 ELSE 3 END * 2)::INT AS source_page,
  CASE event_id % 3 WHEN 0 THEN 'critical' ELSE 'minor' END AS severity, CASE event_type WHEN 'view' THEN 'overlap' ELSE 'other' END AS category FROM events WHERE event_id % 3 < 2 AND event_id % 7 <> 0"""


def q_safe_intents(spark, d):
    k = F.col("event_id") % 6
    replies = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("move", "erase_pad", "replace_text", "recolor", "explode", "resize"))), (k + 1).cast("int")).alias("kind"), F.when(F.col("event_id") % 5 != 0, "title").alias("target"), F.when(F.col("event_id") % 4 != 0, F.col("value") / 50 - 0.5).alias("confidence"), F.when(F.col("event_id") % 2 == 0, "#00ff00").otherwise("green").alias("fill"), F.when(F.col("event_id") % 9 != 0, 2.0).alias("pad"), F.lit("x").alias("to"))
    return R.safe_intents(replies, 0.5).select("event_id", "kind", F.round("confidence", 9).alias("confidence"), "fill")


INTENT_SQL = """
WITH r AS (SELECT event_id, ['move', 'erase_pad', 'replace_text', 'recolor', 'explode', 'resize'][(event_id % 6 + 1)::INT] AS kind, value FROM events WHERE event_id % 5 <> 0)
SELECT event_id, kind, round(CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, value / 50 - 0.5)) END, 9)::DOUBLE AS confidence, CASE WHEN event_id % 2 = 0 THEN '#00ff00' END AS fill FROM r WHERE kind <> 'explode' AND NOT (kind = 'erase_pad' AND event_id % 9 = 0)"""

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_pure_dividers": DIVIDER_SQL,
    "q_page_ribbons": RIBBON.format(TEXTS),
    "q_best_contents": CONTENTS_SQL,
    "q_best_profile": PROFILE_SQL,
    "q_profile_signature": SIGNATURE_SQL,
    "q_layout_specs": "SELECT p_partkey, p_type AS key, p_brand || ' / ' || p_name AS value FROM part UNION ALL SELECT p_partkey, 'SIZE', p_size::VARCHAR FROM part",
    "q_safe_issues": ISSUE_SQL,
    "q_safe_intents": INTENT_SQL,
}
