"""Small rules over the driver's tables: roles of columns, messages, labels, keys, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import signals as S
from pagewright.functions import text as X
from pagewright.operators import adapter as A
from pagewright.queries import sql
from pagewright.queries.carriers import lines, pick, spans, table

HEADERS = ["EAN", "bdd_origine", "Libellé famille", "Longueur", "id", "Identité", "Stock", "date_maj", "Marque", "Marques", "SSFamille", "code produit", "Couleur", "Référence", "Photo", "Désignation"]


def q_technical_columns(spark, d):
    heads = table(spark, d, "supplier").select("s_suppkey", F.concat(pick("s_suppkey", HEADERS), F.when(F.col("s_suppkey") % 5 == 0, "_2").otherwise("")).alias("header"))
    return heads.select("s_suppkey", "header", S.is_technical_column(F.col("header")).alias("technical"))


TECHNICAL_SQL = rf"""
WITH h AS (SELECT s_suppkey, {sql.pick('s_suppkey', HEADERS)} || CASE WHEN s_suppkey % 5 = 0 THEN '_2' ELSE '' END AS header FROM supplier)
SELECT s_suppkey, header, regexp_matches(strip_accents(header), '^(bdd[_.]|libelle[_ ]?(s?s)?famille|sfamille|ssfamille|gencod|gtin|ean|upc|isbn|attribut|statut|marque$|nf$|code\s?produit$|id$|uid$|uuid$|guid$|fournisseur$|supplier$|vendor$|stock$|warehouse$|entrepot$|obsolete$|archive$|deleted$|inactif$|version$|revision$|rev$|created_at$|updated_at$|date_creation$|date_modification$|date_maj$)', 'i') AS technical FROM h"""

ROLE_HEADERS = ["Produit", "Nom", "Prix", "Référence", "Coloris", "Photo", "Libellé famille", "Libellé sfamille", "Rayon", "Family", "Désignation", "EAN", "Finition", "Images"]


def role_headers(spark, d):
    """Headers of small tables: a supplier's customers stand for its columns."""
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 97).cast("string").alias("path"), F.col("c_custkey").cast("int").alias("col_idx"))
    return rows.withColumn("header", F.concat(pick("col_idx", ROLE_HEADERS), F.when(F.col("col_idx") % 3 == 0, F.lit(" x")).otherwise("")))


def q_column_roles(spark, d):
    """Roles by pattern; then those that a reply fills, of which only open roles and headers that exist count."""
    heads = role_headers(spark, d)
    found = A.column_roles(heads.filter("col_idx % 2 = 0 OR header LIKE 'P%'"))
    reply = heads.groupBy("path").agg(F.min_by("header", "col_idx").alias("header")).select("path", F.lit("color").alias("role"), "header").unionByName(heads.select("path").distinct().select("path", F.lit("family").alias("role"), F.lit("not there").alias("header")))
    return A.with_reply(found, reply, heads.dropDuplicates(["path", "header"])).select("path", "role", "header")


ROLE_SQL = r"""
WITH h AS (SELECT (c_custkey % 97)::VARCHAR AS path, c_custkey::INT AS i, {} || CASE WHEN c_custkey % 3 = 0 THEN ' x' ELSE '' END AS header FROM customer),
k AS (SELECT *, lower(strip_accents(header)) AS p FROM h WHERE i % 2 = 0 OR header LIKE 'P%'),
r AS (
  SELECT path, 'name' AS role, header, i, CASE WHEN starts_with(p, 'designation') THEN 0 WHEN starts_with(p, 'nom') THEN 1 WHEN starts_with(p, 'produit') THEN 2 END AS rank FROM k
  UNION ALL SELECT path, 'sku', header, i, CASE WHEN regexp_matches(p, 'ref|ean') THEN 0 END FROM k
  UNION ALL SELECT path, 'color', header, i, CASE WHEN regexp_matches(p, '^(coloris|finition)') THEN 0 END FROM k
  UNION ALL SELECT path, 'image', header, i, CASE WHEN p IN ('photo', 'photos', 'image', 'images') THEN 0 END FROM k
  UNION ALL SELECT path, 'section', header, i, CASE WHEN contains(p, 'libelle sfamille') THEN 1 WHEN contains(p, 'libelle famille') THEN 2 WHEN starts_with(p, 'rayon') THEN 3 END FROM k
  UNION ALL SELECT path, 'family', header, i, CASE WHEN p = 'libelle famille' THEN 0 WHEN starts_with(p, 'family') THEN 1 END FROM k),
f AS (SELECT path, role, header FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path, role ORDER BY rank, i) = 1)
SELECT * FROM f UNION ALL SELECT path, 'color', arg_min(header, i) FROM h WHERE path NOT IN (SELECT path FROM f WHERE role = 'color') GROUP BY path""".format(sql.pick("c_custkey", ROLE_HEADERS))

RIBBONS = [("steel", ["STEEL", "acier"]), ("metal", ["Copper", "brass"]), ("soft", ["tin", ""])]


def q_family_ribbon(spark, d):
    return table(spark, d, "part").select("p_partkey", S.family_ribbon(F.col("p_type"), RIBBONS).alias("ribbon"))


def q_font_suffix(spark, d):
    font = F.when(F.col("l_linenumber") % 3 == 0, F.concat_ws("-", "l_returnflag", F.lit("Sub"), "l_linestatus")).when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag")).otherwise("")
    return table(spark, d, "lineitem").groupBy(S.font_suffix(font, "Regular").alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


REFERENCES = ["", " page 12", " p. 7", " S.12", " Seite 9", "3/4", " pág 5", " P 12", " pagina 123", " step. 3", " apage 5", " p.12345"]
LABELS = ["12", "p. 12", "Page 7", "→ 3", "s. 4", "seite 5", "12 x", "p12.", "12345", "•2", " pág. 8 ", "x 1"]


def q_page_references(spark, d):
    rows = lines(spark, d).withColumn("k", F.col("doc_id") + F.col("pos"))
    text = F.concat(F.col("line"), pick("k", REFERENCES))
    return rows.select("doc_id", "pos", S.says(text, S.PAGE_REFERENCE).alias("refers"), S.says(pick("k", LABELS), S.PAGE_LABEL).alias("is_number"))


REFERENCE_SQL = rf"""
SELECT doc_id, pos::INTEGER AS pos, regexp_matches(line || {sql.pick('(doc_id + pos)', REFERENCES)}, '\b(page|pag(ina)?|pág(ina)?|seite)\.?\s+[0-9]{{1,4}}\b|\b[ps]\.\s*[0-9]{{1,4}}\b', 'i') AS refers,
  regexp_matches({sql.pick('(doc_id + pos)', LABELS)}, '^\s*(p(age|ag|ág|gs?|agina|ágina)?\.?\s+|p\.?\s*|seite\s+|s\.\s*|[→▸▶▷►●•‣]\s+)?[0-9]{{1,4}}\.?\s*$', 'i') AS is_number FROM {sql.LINES}"""


def q_sample_text(spark, d):
    rows = spans(spark, d).withColumn("text", F.repeat(F.concat(F.lit(" "), "font", F.lit("x "), F.col("ord").cast("string")), (F.col("ord") * 4 - 4).cast("int")))
    return rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t")).select("page", S.sample_text(F.transform("t", lambda x: x["text"])).alias("sample"))


SAMPLE_SQL = f"""
WITH s AS (SELECT page, ord, trim(repeat(' ' || font || 'x ' || ord, (ord * 4 - 4)::INT)) AS t FROM {sql.SPANS}),
c AS (SELECT page, ord, t, sum(length(t) + 3) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3 AS before FROM s WHERE t <> '')
SELECT p.page, substr(coalesce(string_agg(t, ' | ' ORDER BY ord) FILTER (WHERE before IS NULL OR before <= 150), ''), 1, 200) AS sample FROM (SELECT DISTINCT page FROM s) p LEFT JOIN c USING (page) GROUP BY p.page"""

MESSAGES = ["429: quota exceeded, please retry in 53.55s.", "500: code 4290", "HTTP 503 overloaded, try again later", "auth expired", "401 Unauthorized", "404 model not found", "Rate-limit hit; retry in 1000s", "circuit ouvert", "ok", "retry in 0s", "X429 nothing", "internal error"]


def q_failure_kinds(spark, d):
    m = pick("event_id", MESSAGES)
    return table(spark, d, "events").select("event_id", S.says(m, S.AUTH).alias("auth"), S.says(m, S.QUOTA).alias("quota"), S.says(m, S.OVERLOADED).alias("overloaded"), S.says(m, S.UNAVAILABLE).alias("unavailable"), X.retry_delay_ms(m).cast("long").alias("wait_ms"))


FAILURE_SQL = r"""
WITH e AS (SELECT event_id, {} AS m FROM events), r AS (SELECT *, try_cast(regexp_extract(m, 'retry in\s+([0-9]+(\.[0-9]+)?)\s*s', 1, 'i') AS DOUBLE) AS s FROM e)
SELECT event_id, regexp_matches(m, 'auth\s+expir|claude\s+login|401|authentication_error|invalid\s+authentication', 'i') AS auth,
  regexp_matches(m, '(^|[^a-z0-9])429([^a-z0-9]|$)|quota|rate.?limit|circuit ouvert', 'i') AS quota,
  regexp_matches(m, '(^|[^0-9])(500|502|503|504)([^0-9]|$)|overload|high demand|experiencing high|try again later|temporarily unavailable|internal error', 'i') AS overloaded,
  regexp_matches(m, '(^|[^0-9])404([^0-9]|$)|not found|not supported|not available|does not exist|unavailable', 'i') AS unavailable,
  CASE WHEN s > 0 THEN least(floor(s * 1000 + 0.5)::BIGINT, 300000) END AS wait_ms FROM r""".format(sql.pick("event_id", MESSAGES))


def q_request_tokens(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    return rows.select("conv_id", S.request_tokens(F.col("texts"), F.col("conv_id") % 3, F.when(F.col("conv_id") % 2 == 0, F.lit(2048))).alias("tokens"))


def q_identifiers(spark, d):
    values = F.array(F.concat(F.lit(" "), F.col("p_partkey").cast("string")), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), "p_brand", "p_brand", F.lit("ab"))
    return table(spark, d, "part").select("p_partkey", S.identifiers(values).alias("ids"))


IDENTIFIER_SQL = """
WITH v AS (SELECT p_partkey, unnest([{'i': 0, 'v': trim(' ' || p_partkey)}, {'i': 1, 'v': lpad(p_partkey::VARCHAR, 8, '0')}, {'i': 2, 'v': p_brand}, {'i': 4, 'v': 'ab'}]) AS u FROM part),
k AS (SELECT p_partkey, u.v AS v, min(u.i) AS i FROM v WHERE length(u.v) >= 3 GROUP BY 1, 2)
SELECT p_partkey, list(v ORDER BY length(v) DESC, i) AS ids FROM k GROUP BY 1"""

ENTRIES = ["Éviers ..... 42", "Bacs 7", "Nothing", "2024", "Table 3 .. 12 . ", "A1 b22", "x 0"]


def q_page_numbers(spark, d):
    """Numbers of page labels, and the tails of contents entries with the place where they begin."""
    t = pick("ord", ENTRIES)
    rows = spans(spark, d).withColumn("t", t)
    return rows.select("page", "ord", S.current_number(F.col("t")).alias("number"), S.contents_tail(F.col("t")).alias("tail"), F.round(S.tail_left(F.col("t"), F.col("x0"), F.col("x1")), 6).alias("tail_x0"))


NUMBER_SQL = rf"""
WITH s AS (SELECT page, ord, x0, x1, {sql.pick('ord', ENTRIES)} AS t FROM {sql.SPANS}), k AS (SELECT *, regexp_extract(t, '([0-9]+[ .\t]*)$', 1) AS g, regexp_replace(t, '[^0-9]', '', 'g') AS n FROM s),
m AS (SELECT *, CASE WHEN g = '' OR g = t THEN t ELSE g END AS tail FROM k)
SELECT page, ord, nullif(try_cast(n AS INTEGER), 0) AS number, tail, round(x1 - (x1 - x0) * length(tail) / length(t), 6) AS tail_x0 FROM m"""


def q_infer_gate(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") % 3 != F.col("p_partkey") % 3).alias("empty"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("p_size") < 3, F.col("p_type"))).alias("sections"))
    return rows.select("p_brand", A.should_infer(F.col("empty"), F.col("n"), F.col("sections")).alias("infer"))


def q_image_gate(spark, d):
    """Sections with too many products without an image, and the images that a reply gives to products without one: known ones only."""
    part = table(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 5 < 3, F.concat(F.lit("own"), F.col("p_partkey").cast("string"))).alias("image"))
    gate = part.groupBy("p_brand").agg(F.avg(F.col("image").isNull().cast("double")).alias("share")).filter("share > 0.3").select("p_brand")
    assets = part.filter("p_partkey % 4 = 1").select(F.concat(F.lit("asset"), F.col("p_partkey").cast("string")).alias("asset"))
    reply = part.select("p_partkey", F.concat(F.lit("asset"), F.col("p_partkey").cast("string")).alias("asset")).join(assets, "asset", "left_semi")
    asked = part.join(gate, "p_brand", "left_semi").join(reply, "p_partkey", "left")
    return asked.select("p_partkey", F.coalesce("image", "asset").alias("image"))


GATE_SQL = """
WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 5 < 3 THEN 'own' || p_partkey END AS image FROM part), g AS (SELECT p_brand FROM p GROUP BY 1 HAVING avg((image IS NULL)::INT) > 0.3)
SELECT p_partkey, coalesce(image, CASE WHEN p_partkey % 4 = 1 THEN 'asset' || p_partkey END) AS image FROM p WHERE p_brand IN (SELECT p_brand FROM g)"""


def q_trimmed_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", S.trimmed_keys(F.split("text", r"[,.\n]")).alias("keys"))
    return docs.select("doc_id", F.array_sort("keys").alias("keys"))


def q_cache_keys(spark, d):
    """Keys of cached answers that are still fresh on the last day: prompt and payload, thirty days."""
    rows = table(spark, d, "events").withColumn("key", S.cache_key(F.col("event_type"), F.encode(F.col("user_id").cast("string"), "utf-8"), F.encode("props", "utf-8")))
    last = rows.agg(F.max("ts").alias("now"))  # one row
    return rows.join(F.broadcast(last)).filter(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= 30 * 86_400_000_000).groupBy("key").agg(F.max("event_id").alias("event_id"))


def q_warnings(spark, d):
    """Products without a name, references given twice (the first five), and tables whose products lack assets."""
    part = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_type")
    products = part.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("row_idx"), F.when(F.col("p_size") > 2, F.col("p_type")).alias("name"), F.when(F.col("p_partkey") % 7 < 5, F.concat_ws("-", F.col("p_size").cast("string"), F.split("p_type", " ")[0])).alias("ref"))
    assets = products.select("path", "row_idx", F.when(F.col("row_idx") % 10 < 7, F.lit("a")).alias("asset"))
    return A.warnings(products, assets)


WARNING_SQL = """
WITH p AS (SELECT p_brand AS path, p_partkey AS i, p_size > 2 AS named, CASE WHEN p_partkey % 7 < 5 THEN p_size || '-' || string_split(p_type, ' ')[1] END AS ref FROM part),
t AS (SELECT path, ref, min(i) AS f FROM p WHERE ref IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1), l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY f) AS r FROM t)
SELECT path, 'nameless' AS warning, count(*) AS n, NULL::VARCHAR AS detail FROM p WHERE NOT named GROUP BY 1
UNION ALL SELECT path, 'same reference', count(*), string_agg(ref, ', ' ORDER BY r) FILTER (WHERE r <= 5) FROM l GROUP BY 1
UNION ALL SELECT path, 'ask for assets', count(*) FILTER (WHERE i % 10 >= 7), NULL FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE i % 10 >= 7) / count(*) > 0.3"""


def q_descriptions(spark, d):
    """A reply's descriptions of sections: those asked for, which say something, of 300 characters at most."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("  "), F.substring("text", 1, 150), F.substring("text", 10, 160)).alias("t"), pick("doc_id", ["en", "fr", "xx"]).alias("label"))
    return rows.select("doc_id", S.safe_description(F.when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.col("t")), F.col("label"), F.array(F.lit("en"), F.lit("fr")), 300).alias("description"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_technical_columns": TECHNICAL_SQL,
    "q_column_roles": ROLE_SQL,
    "q_family_ribbon": "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'acier') THEN 'steel' WHEN contains(lower(p_type), 'copper') OR contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_type), 'tin') THEN 'soft' ELSE lower(p_type) END AS ribbon FROM part",
    "q_font_suffix": "SELECT CASE l_linenumber % 3 WHEN 0 THEN l_linestatus WHEN 1 THEN l_returnflag ELSE 'Regular' END AS suffix, count(*) AS n FROM lineitem GROUP BY 1",
    "q_page_references": REFERENCE_SQL,
    "q_sample_text": SAMPLE_SQL,
    "q_failure_kinds": FAILURE_SQL,
    "q_request_tokens": "SELECT conv_id, (sum(ceil(length(coalesce(text, '')) / 4)) + 300 * (conv_id % 3) + CASE WHEN conv_id % 2 = 0 THEN 2048 ELSE 1024 END)::BIGINT AS tokens FROM conversations GROUP BY conv_id",
    "q_identifiers": IDENTIFIER_SQL,
    "q_page_numbers": NUMBER_SQL,
    "q_infer_gate": "SELECT p_brand, count(*) FILTER (WHERE p_size % 3 <> p_partkey % 3) / count(*) > 0.5 AND count(DISTINCT CASE WHEN p_size < 3 THEN p_type END) >= 2 AS infer FROM part GROUP BY 1",
    "q_image_gate": GATE_SQL,
    "q_trimmed_keys": r"SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[,.\n]'), lambda x: trim(x)), lambda x: length(x) BETWEEN 1 AND 79))) AS keys FROM documents",
    "q_cache_keys": "SELECT sha256(event_type || user_id || props) AS key, max(event_id) AS event_id FROM events WHERE (SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts) <= 30 * 86400000000 GROUP BY 1",
    "q_warnings": WARNING_SQL,
    "q_descriptions": "SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND doc_id % 11 <> 0 AND length(trim('  ' || substr(text, 1, 150) || substr(text, 10, 160), ' ' || chr(10))) <= 300 AND trim('  ' || substr(text, 1, 150) || substr(text, 10, 160), ' ' || chr(10)) <> '' THEN trim('  ' || substr(text, 1, 150) || substr(text, 10, 160), ' ' || chr(10)) END AS description FROM documents",
}
