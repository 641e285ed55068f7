"""Model replies as tables: parsing, gates, gap filling, rules, selectors, cascades."""

from __future__ import annotations

from pyspark.sql import functions as F


from pagewright.operators import enrichment as E
from pagewright.queries import sql
from pagewright.queries.carriers import table
from pagewright.queries.texts import UNIT


def q_parse_reply(spark, d):
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(k == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise("no JSON at all")
    v = E.parse_reply(reply)
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "long"), F.try_variant_get(v, "$[0].k", "long")).alias("k"))


def q_fill_gaps(spark, d):
    """Customers without a segment get one from replies about their nation, where the reply is a segment that exists."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("segment"))
    replies = table(spark, d, "customer").filter("c_custkey % 3 = 1").select("c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("SPACE").alias("reply"), F.col("c_custkey").alias("reply_ord"))
    known = table(spark, d, "customer").select("c_mktsegment")
    return E.fill_gaps(rows, replies, "c_nationkey", "segment", known, "c_mktsegment").select("c_custkey", "segment")


FILL_SQL = """
WITH r AS (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'SPACE' END AS reply, c_custkey AS o FROM customer WHERE c_custkey % 3 = 1),
f AS (SELECT c_nationkey, arg_min(reply, o) AS reply FROM r WHERE reply IN (SELECT c_mktsegment FROM customer) GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE f.reply END AS segment FROM customer LEFT JOIN f USING (c_nationkey)"""


def q_key_gate(spark, d):
    template = table(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.initcap("n_name").alias("spec_key"))
    product = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.concat(F.lit("_"), F.lower("n_name"))).alias("spec_key"))
    return E.key_gate(product, template, "spec_key").select("n_keys", F.round("mismatch", 9).alias("mismatch"), F.round("suspect", 9).alias("suspect"), "ask")


GATE_SQL = """
WITH t AS (SELECT DISTINCT regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') AS k FROM nation WHERE n_nationkey % 3 = 0), p AS (SELECT DISTINCT CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE '_' || lower(n_name) END AS s FROM nation),
r AS (SELECT count(*) AS n_keys, avg((regexp_replace(lower(s), '[^a-z0-9]+', '', 'g') NOT IN (SELECT k FROM t))::INT) AS m, avg(contains(s, '_')::INT) AS u FROM p)
SELECT n_keys, round(m, 9) AS mismatch, round(u, 9) AS suspect, m >= 0.5 AND u >= 0.5 AS ask FROM r"""


def q_format_mismatch(spark, d):
    part = table(spark, d, "part")
    template = part.filter("p_partkey % 2 = 0").select("p_brand", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " cm").otherwise("")).alias("v"))
    product = part.filter("p_partkey % 2 = 1").select("p_brand", F.when(F.substring("p_brand", -1, 1) == "1", F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("v"))
    return E.format_mismatches(template, product, "p_brand", "v")


MISMATCH_SQL = f"""
WITH t AS (SELECT p_brand, avg(length(v)) AS tl, bool_or(regexp_matches(v, {sql.quote(f'[0-9][ \\t]*(?:{UNIT})(?:[^A-Za-zÀ-ÿ]|$)')})) AS tu FROM (SELECT p_brand, p_size || CASE WHEN p_partkey % 3 = 0 THEN ' cm' ELSE '' END AS v FROM part WHERE p_partkey % 2 = 0) GROUP BY 1),
p AS (SELECT p_brand, avg(length(v)) AS pl, bool_or(regexp_matches(v, {sql.quote(f'[0-9][ \\t]*(?:{UNIT})(?:[^A-Za-zÀ-ÿ]|$)')})) AS pu FROM (SELECT p_brand, CASE WHEN p_brand[-1:] = '1' THEN p_name ELSE p_size::VARCHAR END AS v FROM part WHERE p_partkey % 2 = 1) GROUP BY 1)
SELECT p_brand, (tl > pl * 1.5 AND tl - pl >= 2) OR (pl > tl * 1.5 AND pl - tl >= 2) OR (tu AND NOT pu) AS mismatch FROM t JOIN p USING (p_brand)"""


def q_apply_rules(spark, d):
    rule = F.element_at(F.array(F.lit("{value} cm"), F.lit("Ø {n} mm"), F.lit("standard"), F.lit(None).cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    value = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 5 == 0, " CM").otherwise(""))
    return table(spark, d, "part").select("p_partkey", E.apply_rule(value, rule).alias("value"))


RULE_SQL = """
WITH p AS (SELECT p_partkey, p_size || CASE WHEN p_partkey % 5 = 0 THEN ' CM' ELSE '' END AS v FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 5 = 0 THEN v ELSE v || ' cm' END WHEN 1 THEN 'Ø ' || v || ' mm' WHEN 2 THEN 'standard' ELSE v END AS value FROM p"""


def q_selectors(spark, d):
    """Selectors of edits resolved against the zones of a page's products."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") - 1).alias("product"), F.col("l_partkey").alias("part_id")).dropDuplicates(["page", "product"])
    title = li.select("page", "product", F.lit("title").alias("zone"), F.lit(None).cast("int").alias("item"), F.lit(None).cast("string").alias("part"), F.concat_ws("-", F.lit("t"), "page", "product").alias("box"))
    item = li.select("page", "product", F.lit("specs_block").alias("zone"), F.lit(1).alias("item"), F.explode(F.array(F.lit("key"), F.lit("value"))).alias("part")).withColumn("box", F.concat_ws("-", "part", "page", "product"))
    banner = li.select("page").distinct().select("page", F.lit(None).cast("int").alias("product"), F.lit("banner").alias("zone"), F.lit(None).cast("int").alias("item"), F.lit(None).cast("string").alias("part"), F.concat_ws("-", F.lit("b"), "page").alias("box"))
    targets = F.explode(F.array(*map(F.lit, ("product_1.title", "title", "product_0.specs_block.item_1.key", "product_2.specs_block.item_1", "product_9.title", "banner", "nothing"))))
    return E.resolve_targets(li.select("page").distinct().withColumn("target", targets), title.unionByName(item).unionByName(banner))


SELECTOR_SQL = """
WITH l AS (SELECT DISTINCT l_orderkey AS page, l_linenumber - 1 AS k FROM lineitem), p AS (SELECT DISTINCT page FROM l), t(target) AS (VALUES ('product_1.title'), ('title'), ('product_0.specs_block.item_1.key'), ('product_2.specs_block.item_1'), ('product_9.title'), ('banner'), ('nothing')),
i AS (SELECT page, target, CASE target WHEN 'product_1.title' THEN 1 WHEN 'product_2.specs_block.item_1' THEN 2 WHEN 'product_9.title' THEN 9 ELSE 0 END AS k FROM p, t)
SELECT i.page, i.target, CASE WHEN target = 'banner' THEN 'b-' || i.page WHEN target = 'nothing' OR l.k IS NULL THEN NULL WHEN target LIKE '%title' THEN 't-' || i.page || '-' || i.k WHEN target LIKE '%key' THEN 'key-' || i.page || '-' || i.k ELSE 'value-' || i.page || '-' || i.k END AS box
FROM i LEFT JOIN l ON l.page = i.page AND l.k = i.k"""


def q_cascade(spark, d):
    """Events of a user and day as attempts on models, in order."""
    outcome = F.when(F.col("event_type") == "error", "quota").when(F.col("event_type") == "view", "server").when(F.col("event_type") == "click", "ok").otherwise("refused")
    rows = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("attempt"), outcome.alias("outcome"))
    return E.cascade(rows, ["user_id", "day"])


CASCADE_SQL = """
WITH a AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, CASE event_type WHEN 'error' THEN 'quota' WHEN 'view' THEN 'server' WHEN 'click' THEN 'ok' ELSE 'refused' END AS o FROM events),
f AS (SELECT user_id, day, max(event_id) AS last, min(CASE WHEN o IN ('ok', 'refused') THEN event_id END) AS e FROM a GROUP BY 1, 2)
SELECT f.user_id, f.day, coalesce(a.o, 'exhausted') AS result, coalesce(e, last) AS attempt FROM f LEFT JOIN a ON a.event_id = f.e"""

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_parse_reply": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props->>'$.k')::BIGINT END AS k FROM events",
    "q_fill_gaps": FILL_SQL,
    "q_key_gate": GATE_SQL,
    "q_format_mismatch": MISMATCH_SQL,
    "q_apply_rules": RULE_SQL,
    "q_selectors": SELECTOR_SQL,
    "q_cascade": CASCADE_SQL,
}

