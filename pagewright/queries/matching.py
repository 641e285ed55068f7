"""Likeness joins: assets to names, labels to names, keys to keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import lexicons as L
from pagewright.functions import text as X
from pagewright.operators.joins import infer_section, match_tiers
from pagewright.queries import sql
from pagewright.queries.carriers import table


def q_asset_match(spark, d):
    """Assets named after parts, in one of several spellings, matched back to the names."""
    part = table(spark, d, "part")
    k = F.col("p_partkey") % 5
    asset = F.when(k == 0, F.lower("p_name")).when(k == 1, F.concat(F.lower("p_name"), F.lit("-v2"))).when(k == 2, F.regexp_replace(F.lower("p_name"), " ", "_")).when(k == 3, F.concat(F.lit("img "), F.lower("p_name"))).otherwise(F.substring("p_name", 1, 5))
    assets = part.groupBy(asset.alias("stem")).agg(F.min("p_partkey").alias("asset_ord"))
    return match_tiers(part.select("p_partkey", "p_name"), assets, "p_partkey", "p_name", "stem", "asset_ord")


ASSET_SQL = """
WITH p AS (SELECT p_partkey, p_name, lower(p_name) AS c, regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]+', '', 'g') AS cn FROM part),
a AS (SELECT stem, min(p_partkey) AS ord FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(p_name) WHEN 1 THEN lower(p_name) || '-v2' WHEN 2 THEN replace(lower(p_name), ' ', '_') WHEN 3 THEN 'img ' || lower(p_name) ELSE substr(p_name, 1, 5) END AS stem FROM p) GROUP BY 1),
b AS (SELECT stem, ord, lower(stem) AS b, regexp_replace(strip_accents(lower(stem)), '[^a-z0-9]+', '', 'g') AS bn FROM a),
t AS (SELECT p_partkey, stem, ord, CASE WHEN c = b THEN 1 WHEN strip_accents(c) = b THEN 2 WHEN starts_with(b, c) THEN 3 WHEN contains(b, c) THEN 4 WHEN length(b) >= 4 AND contains(c, b) THEN 5
  WHEN length(cn) >= 3 AND contains(bn, cn) THEN 6 WHEN length(cn) >= 3 AND length(bn) >= 4 AND contains(cn, bn) THEN 7
  WHEN length(ltrim(cn, '0')) >= 3 AND ltrim(cn, '0') <> cn AND contains(bn, ltrim(cn, '0')) THEN 8 WHEN length(cn) >= 3 AND length(ltrim(bn, '0')) >= 3 AND contains(ltrim(bn, '0'), cn) THEN 9 END AS tier FROM p, b),
r AS (SELECT * FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY tier, ord) = 1)
SELECT p.p_partkey, r.stem AS asset, r.tier FROM p LEFT JOIN r USING (p_partkey)"""


def labels(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.split("text", "\n", -1)[0].alias("label"))
    return rows.select("item_id", "label", X.name_tokens(F.col("label")).alias("label_tokens"))


def q_infer_section(spark, d):
    """Section of each document by its first line, among the first lines of the items."""
    docs = table(spark, d, "documents").select("doc_id", X.name_tokens(F.split("text", "\n", -1)[0]).alias("tokens"))
    out = infer_section(docs, labels(spark, d), "doc_id", "tokens", "label", "label_tokens", "item_id")
    return out.select("doc_id", "label", F.round("score", 9).alias("score"))


TOKENS = "list_filter(string_split({}, ' '), lambda t: length(t) >= 3 AND NOT list_contains([" + ", ".join(map(sql.quote, L.STOP_WORDS)) + "], t))"
INFER_SQL = f"""
WITH p AS (SELECT doc_id, list_distinct({TOKENS.format(sql.section("string_split(text, chr(10))[1]"))}) AS a FROM documents),
q AS (SELECT item_id, string_split(text, chr(10))[1] AS label, list_distinct({TOKENS.format(sql.section("string_split(text, chr(10))[1]"))}) AS b FROM benchmark),
x AS (SELECT doc_id, item_id, label, a, b, u.t AS ta FROM (SELECT doc_id, a, unnest(list_transform(a, lambda t: {{'t': t}})) AS u FROM p), q WHERE len(b) > 0),
m AS (SELECT doc_id, item_id, label, len(a) AS na, len(b) AS nb, count(*) FILTER (WHERE len(list_filter(b, lambda y: starts_with(ta, y) OR starts_with(y, ta))) > 0) AS common FROM x GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT doc_id, item_id, label, common / least(na, nb) AS score FROM m),
r AS (SELECT * FROM s WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1)
SELECT p.doc_id, r.label, round(r.score, 9) AS score FROM p LEFT JOIN r USING (doc_id)"""


def q_section_overlap(spark, d):
    """Sections of a template (suppliers' nations) that fit those of the products (regions and nations): equal keys or half of the tokens."""
    template = table(spark, d, "nation").select(F.col("n_nationkey"), X.normalize_section(F.col("n_name")).alias("t_key"))
    product = table(spark, d, "region").select("r_regionkey", X.normalize_section(F.concat_ws(" ", "r_name", F.lit("UNITED NORTH"))).alias("p_key")).unionByName(table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("r_regionkey"), X.normalize_section(F.col("n_name")).alias("p_key")))
    long = lambda x: F.filter(F.split(x, " "), lambda t: F.length(t) >= 3)
    t = template.withColumn("tt", long(F.col("t_key"))).withColumn("token", F.explode("tt"))
    p = product.withColumn("pt", long(F.col("p_key"))).withColumn("token", F.explode(F.array_distinct("pt")))
    met = t.join(p, "token").groupBy("n_nationkey", "r_regionkey", "t_key", "p_key", F.size("tt").alias("a"), F.size("pt").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    return met.filter((F.col("t_key") == F.col("p_key")) | (F.col("common") / F.least("a", "b") >= 0.5)).select("n_nationkey", "r_regionkey")


SECTION_OVERLAP_SQL = f"""
WITH t AS (SELECT n_nationkey, {sql.section('n_name')} AS k FROM nation), p AS (SELECT r_regionkey, {sql.section("r_name || ' UNITED NORTH'")} AS k FROM region UNION ALL SELECT n_nationkey + 100, {sql.section('n_name')} FROM nation),
x AS (SELECT n_nationkey, r_regionkey, t.k AS tk, p.k AS pk, list_filter(string_split(t.k, ' '), lambda w: length(w) >= 3) AS a, list_filter(string_split(p.k, ' '), lambda w: length(w) >= 3) AS b FROM t, p),
c AS (SELECT *, len(list_filter(a, lambda w: list_contains(b, w))) AS common FROM x)
SELECT n_nationkey, r_regionkey::INTEGER AS r_regionkey FROM c WHERE (tk = pk AND len(a) > 0) OR (common > 0 AND common / least(len(a), len(b)) >= 0.5)"""


def q_spec_key_join(spark, d):
    """Template keys and product keys that are equal as letters and digits."""
    template = table(spark, d, "nation").select(F.concat(F.initcap("n_name"), F.lit(" :")).alias("t_key"), "n_regionkey")
    product = table(spark, d, "customer").join(table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("name")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.concat(F.lit("_"), F.regexp_replace("name", " ", "_")).alias("p_key")).agg(F.count(F.lit(1)).alias("n"))
    return template.join(product, X.bare_key(F.col("t_key")) == X.bare_key(F.col("p_key"))).select("t_key", "n_regionkey", "p_key", "n")


KEY_SQL = """
WITH t AS (SELECT n_name AS raw, n_regionkey FROM nation), p AS (SELECT '_' || replace(lower(n_name), ' ', '_') AS p_key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT array_to_string(list_transform(string_split(raw, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' :' AS t_key, n_regionkey, p_key, n
FROM t JOIN p ON regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') = regexp_replace(p_key, '[^a-z0-9]+', '', 'g')"""

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {"q_asset_match": ASSET_SQL, "q_infer_section": INFER_SQL, "q_section_overlap": SECTION_OVERLAP_SQL, "q_spec_key_join": KEY_SQL}
