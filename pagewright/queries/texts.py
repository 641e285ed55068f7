"""String rules over document lines and names."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagewright.functions import lexicons as L
from pagewright.functions import text as X
from pagewright.functions.values import normalize_values
from pagewright.operators.ingest import delimiter_scores, header_row
from pagewright.operators.ranking import best
from pagewright.queries import sql
from pagewright.queries.carriers import lines, table


def q_strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", X.strip_accents(F.col("text")).alias("plain"))


def q_normalize_section(spark, d):
    return lines(spark, d).select("doc_id", "pos", X.normalize_section(F.col("line")).alias("section_key"))


def q_slugify(spark, d):
    return lines(spark, d).select("doc_id", "pos", X.slugify(F.col("line")).alias("slug"))


HEADERS = ["538_Longueur", "100 Matiere", "DEB_PRESS", "dim", "Temp MAX", "Ref-fournisseur", "Nb bacs", "QTE", "Finition", "vol surf"]


def q_humanize_key(spark, d):
    brands = table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.posexplode(F.array(*map(F.lit, HEADERS))).alias("header_id", "header"))
    return brands.select(F.col("header_id").cast("long").alias("header_id"), "p_brand", X.humanize_key(F.concat_ws(" ", "header", "p_brand")).alias("printed"))


def humanize_sql() -> str:
    # No lookarounds in RE2: the words of a header are looked up one by one.
    cases = " ".join(f"WHEN {sql.quote(a)} THEN {sql.quote(b)}" for a, b in L.ABBREVIATIONS)
    heads = ", ".join(f"({i}, {sql.quote(h)})" for i, h in enumerate(HEADERS))
    return f"""
    WITH h(header_id, header) AS (VALUES {heads}), b AS (SELECT DISTINCT p_brand FROM part),
    k AS (SELECT header_id, p_brand, string_split(regexp_replace(regexp_replace(header || ' ' || p_brand, '[_\\-]+', ' ', 'g'), '^\\d{{1,4}}\\s+', ''), ' ') AS w FROM h, b)
    SELECT header_id::BIGINT AS header_id, p_brand, upper(array_to_string(list_transform(w, lambda x: CASE lower(x) {cases} ELSE x END), ' ')) || ' :' AS printed FROM k"""


def q_clean_value(spark, d):
    return lines(spark, d).select("doc_id", "pos", X.clean_value(F.col("line")).alias("value"))


def clean_sql(x: str) -> str:
    words = "|".join([*map(re.escape, L.NON_INFORMATIVE), *L.NON_INFORMATIVE_PATTERNS])
    t = f"trim({x})"
    unquoted = t
    for a, b in reversed(L.QUOTES):
        unquoted = f"CASE WHEN length({t}) >= 2 AND starts_with({t}, {sql.quote(a)}) AND ends_with({t}, {sql.quote(b)}) THEN trim(substr({t}, 2, length({t}) - 2)) ELSE {unquoted} END"
    bare = "trim(regexp_replace(v, '[.,;:]+$', ''))"
    return f"CASE WHEN v <> '' AND {bare} <> '' AND NOT regexp_full_match({bare}, {sql.quote(words)}, 'i') THEN v END AS value", unquoted


CLEAN = clean_sql("line")


def q_split_multi(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.split_values(F.col("text"))).alias("pos", "value")).select("doc_id", F.col("pos").cast("long").alias("pos"), "value")


WORDS = "|".join([*map(re.escape, L.NON_INFORMATIVE), *L.NON_INFORMATIVE_PATTERNS])
SPLIT_SQL = f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n|\\s+\\|\\s+|\\s+;\\s+'), lambda x: trim(x)),
  lambda x: trim(regexp_replace(x, '[.,;:]+$', '')) <> '' AND NOT regexp_full_match(trim(regexp_replace(x, '[.,;:]+$', '')), {sql.quote(WORDS)}, 'i')) AS v FROM documents)
SELECT doc_id, (u.i - 1)::BIGINT AS pos, u.x AS value FROM (SELECT doc_id, unnest(list_transform(v, lambda x, i: {{'i': i, 'x': x}})) AS u FROM p)"""


def q_kv_split(spark, d):
    parts = X.split_key_value(F.col("line"))
    return lines(spark, d).filter(X.has_key_value(F.col("line"))).select("doc_id", "pos", parts["key"].alias("k"), parts["value"].alias("v"), parts["separator"].alias("sep"))


KV_SQL = f"""
SELECT doc_id, pos::INTEGER AS pos,
  CASE WHEN regexp_matches(line, '[:=|→·]') THEN trim(regexp_extract(line, '^(.*?)(\\s*[:=|→·]\\s*)(.*)$', 1)) ELSE trim(regexp_extract(line, '^(.*?)\\s([—–])\\s(.*)$', 1)) END AS k,
  CASE WHEN regexp_matches(line, '[:=|→·]') THEN trim(regexp_extract(line, '^(.*?)(\\s*[:=|→·]\\s*)(.*)$', 3)) ELSE trim(regexp_extract(line, '^(.*?)\\s([—–])\\s(.*)$', 3)) END AS v,
  CASE WHEN regexp_matches(line, '[:=|→·]') THEN trim(regexp_extract(line, '^(.*?)(\\s*[:=|→·]\\s*)(.*)$', 2)) ELSE trim(regexp_extract(line, '^(.*?)\\s([—–])\\s(.*)$', 2)) END AS sep
FROM {sql.LINES} WHERE regexp_matches(line, '[:=|→·]') OR regexp_matches(line, '\\s[—–]\\s')"""


def q_color_code(spark, d):
    part = table(spark, d, "part")
    colour = F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919 % 16777216).cast("long"))), 6, "0"))
    word = F.element_at(F.split("p_name", " "), 1)
    return part.select("p_partkey", colour.alias("colour"), X.is_common_colour(word).alias("is_colour"), X.is_colour_code(colour).alias("is_code"), X.text_colour_on(colour).alias("text_colour"), X.lighten(colour, 0.5).alias("light"))


COLOUR_SQL = f"""
WITH c AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS w, '#' || lpad(lower(to_hex((p_partkey * 7919 % 16777216)::BIGINT)), 6, '0') AS colour FROM part),
k AS (SELECT *, ('0x' || substr(colour, 2, 2))::INT AS r, ('0x' || substr(colour, 4, 2))::INT AS g, ('0x' || substr(colour, 6, 2))::INT AS b FROM c)
SELECT p_partkey, colour, list_contains([{', '.join(map(sql.quote, L.COLOURS))}], strip_accents(lower(trim(w)))) AS is_colour, true AS is_code,
  CASE WHEN r + g + b >= 700 THEN '#000000' ELSE colour END AS text_colour,
  '#' || lpad(lower(to_hex(floor(r + (255 - r) * 0.5 + 0.5)::BIGINT)), 2, '0') || lpad(lower(to_hex(floor(g + (255 - g) * 0.5 + 0.5)::BIGINT)), 2, '0') || lpad(lower(to_hex(floor(b + (255 - b) * 0.5 + 0.5)::BIGINT)), 2, '0') AS light FROM k"""


def q_unit_detect(spark, d):
    return lines(spark, d).select("doc_id", "pos", X.has_unit(F.col("line")).alias("has_unit"))


UNIT = "|".join(map(re.escape, sorted(L.UNITS, key=len, reverse=True)))
UNIT_SQL = f"""SELECT doc_id, pos::INTEGER AS pos, regexp_matches(line, {sql.quote(f'[0-9][ \\t]*(?:{UNIT})(?:[^A-Za-zÀ-ÿ]|$)')}) OR regexp_matches(line, {sql.quote(f"(?:^|[ \\t])(?:{'|'.join(map(re.escape, L.CURRENCIES))})[ \\t]*[0-9]")}) AS has_unit FROM {sql.LINES}"""


def q_barcode(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[ \n]+")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", "n", X.looks_like_barcode(F.col("word")).alias("barcode"))


BARCODE_SQL = r"""
WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM documents) WHERE word <> '' GROUP BY word),
k AS (SELECT word, n, length(word) AS len, length(word) - length(regexp_replace(word, '[a-zA-ZÀ-ÿœŒæÆ]', '', 'g')) AS letters, length(word) - length(regexp_replace(word, '[0-9]', '', 'g')) AS digits FROM w)
SELECT word, n, CASE WHEN len < 3 THEN false WHEN digits = len AND len >= 5 THEN true WHEN len <= 30 AND (letters + digits) / len >= 0.8 THEN false
  WHEN (len - letters - digits) / len > 0.3 THEN true ELSE letters / len < 0.5 END AS barcode FROM k"""


def q_legal_notice(spark, d):
    return lines(spark, d).select("doc_id", "pos", X.looks_like_legal_notice(F.col("line")).alias("notice"))


LEGAL_SQL = f"""SELECT doc_id, pos::INTEGER AS pos, trim(line) <> '' AND (regexp_matches(line, '[©®™]') OR regexp_matches(trim(line), {sql.quote(f'^({L.LEGAL_OPENINGS})')}, 'i')
  OR (length(trim(line)) > 80 AND len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda w: length(w) > 1)) >= 8)) AS notice FROM {sql.LINES}"""


def q_keyword_class(spark, d):
    docs = table(spark, d, "documents")
    # Words of the carrier take the place of page phrases in every third document.
    page = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))).otherwise(""))
    return docs.select("doc_id", X.page_keyword(page).alias("kind"))


PHRASES = [" Table des matières", " SOMMAIRE", " Key to Symbols", " Données techniques", " Inhaltsverzeichnis", " datasheet", " nothing"]
KEYWORD_SQL = f"""
WITH p AS (SELECT doc_id, lower(strip_accents(text || CASE WHEN doc_id % 3 = 0 THEN [{', '.join(map(sql.quote, PHRASES))}][(doc_id % {len(PHRASES)} + 1)::INT] ELSE '' END)) AS t FROM documents)
SELECT doc_id, CASE {' '.join(f"WHEN {' OR '.join(f'contains(t, {sql.quote(x)})' for x in v)} THEN {sql.quote(k)}" for k, v in L.PAGE_KEYWORDS.items())} END AS kind FROM p"""


def q_text_width(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(X.text_width(F.col("p_name"), F.col("p_size").cast("double")), 6).alias("width"))


def width_sql(x: str) -> str:
    return " + ".join(f"(length({x}) - length(regexp_replace({x}, '{p}', '', 'g'))) * {w - L.OTHER_WIDTH}" for p, w in L.WIDTHS) + f" + length({x}) * {L.OTHER_WIDTH}"


def q_wrap_words(spark, d):
    return lines(spark, d).select("doc_id", "pos", X.wrap_words(F.col("line"), 200.0, 9.0).alias("wrapped"))


#: Words are added to the line while it fits; the width of a line is that of its words and the blanks between them.
WRAP_SQL = f"""
WITH w AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '') AS words FROM {sql.LINES}),
k AS (SELECT doc_id, pos, list_transform(words, lambda x: {{'x': x, 'w': (9.0 * ({width_sql('x')}))::DOUBLE, 'lines': []::VARCHAR[]}}) AS words FROM w),
r AS (SELECT doc_id, pos, list_reduce(words, lambda a, b: CASE WHEN a.w + 2.7 + b.w <= 200.0 THEN {{'x': a.x || ' ' || b.x, 'w': a.w + 2.7 + b.w, 'lines': a.lines}}
  ELSE {{'x': b.x, 'w': b.w, 'lines': list_append(a.lines, a.x)}} END, {{'x': '', 'w': 1000000.0::DOUBLE, 'lines': []::VARCHAR[]}}) AS r FROM k)
SELECT doc_id, pos::INTEGER AS pos, CASE WHEN r.w = 1000000.0 THEN [] ELSE list_append(r.lines, r.x)[2:] END AS wrapped FROM r"""


def q_safe_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.safe_text(F.col("text")).alias("safe"))


def q_dedup_hash(spark, d):
    """Documents whose first 20 words are those of an earlier document."""
    docs = table(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.filter(F.split("text", r"[ \n]+"), lambda w: w != ""), 1, 20), "|").alias("head"))
    first = docs.groupBy(F.sha2("head", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))
    return first.filter("n_docs > 1")


DEDUP_SQL = r"""
WITH h AS (SELECT doc_id, sha256(array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> ''), 1, 20), '|')) AS content_hash FROM documents)
SELECT content_hash, min(doc_id) AS first_doc, count(*) AS n_docs FROM h GROUP BY content_hash HAVING count(*) > 1"""


def q_url_basename(spark, d):
    return table(spark, d, "pages").select("page_id", X.url_basename(F.col("url")).alias("base"))


def q_delimiter(spark, d):
    text = F.regexp_replace("text", r"[#*%&$]+", ";")
    return best(delimiter_scores(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id"), ["doc_id"], [F.desc("score"), F.asc("rank")]).select("doc_id", F.when(F.col("score") > 0, F.col("delimiter")).otherwise(",").alias("delimiter"))


DELIMITER_SQL = r"""
WITH l AS (SELECT doc_id, u.i AS i, u.x AS line FROM (SELECT doc_id, unnest(list_transform(string_split(regexp_replace(text, '[#*%&$]+', ';', 'g'), chr(10)), lambda x, i: {'i': i, 'x': x})) AS u FROM documents) WHERE u.i <= 10 AND trim(u.x) <> ''),
s AS (SELECT doc_id, rank, d, avg(c) / (1 + var_pop(c)) AS score FROM (SELECT doc_id, rank, d, length(line) - length(replace(line, d, '')) AS c FROM l, (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) AS v(rank, d)) GROUP BY doc_id, rank, d)
SELECT doc_id, CASE WHEN score > 0 THEN d ELSE ',' END AS delimiter FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1"""


def q_header_row(spark, d):
    return header_row(lines(spark, d).withColumn("cells", F.size(F.filter(F.split("line", " "), lambda c: c != ""))), "doc_id", "pos", "cells").select("doc_id", F.col("header_row").cast("long").alias("header_row"))


HEADER_SQL = f"SELECT doc_id, coalesce(min(CASE WHEN pos < 5 AND len(list_filter(string_split(line, ' '), lambda c: c <> '')) >= 3 THEN pos END), 0)::BIGINT AS header_row FROM {sql.LINES} GROUP BY doc_id"


def q_json_props(spark, d):
    props = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(props).alias("n_k"), F.sum(props).cast("long").alias("sum_k"))


def q_key_style(spark, d):
    template = F.when(F.col("p_size") % 3 == 0, F.upper("p_type")).when(F.col("p_size") % 3 == 1, F.concat(F.lower("p_type"), F.lit(" ="))).otherwise(F.concat(F.initcap("p_type"), F.lit(" |")))
    return table(spark, d, "part").select("p_partkey", X.style_key(F.col("p_name"), template).alias("styled"))


STYLE_SQL = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN upper(p_name) || ' :' WHEN 1 THEN lower(p_name) || ' =' ELSE p_name || ' |' END AS styled FROM part"


def q_spec_category(spark, d):
    heads = F.element_at(F.array(*[F.lit(h) for h in CATEGORY_HEADS]), (F.col("p_partkey") % len(CATEGORY_HEADS) + 1).cast("int"))
    return table(spark, d, "part").groupBy(X.spec_category(heads).alias("category")).agg(F.count(F.lit(1)).alias("n"))


CATEGORY_HEADS = ["Matière", "LONGUEUR", "Coloris", "Garantie", "Packaging", "Poids net", "Débit", "Box size", "höhe", "Taille", "Capacity", "SAV", "Oberfläche", "Entrées  axes", "Nature du conditionnement", "Méca", "cor", "Corps"]
CATEGORY_SQL = f"""SELECT CASE {' '.join(f"WHEN regexp_matches(lower(h), {sql.quote(p)}) THEN {sql.quote(n)}" for n, p in L.SPEC_CATEGORIES)} ELSE 'AUTRES' END AS category, count(*) AS n
FROM (SELECT [{', '.join(map(sql.quote, CATEGORY_HEADS))}][(p_partkey % {len(CATEGORY_HEADS)} + 1)::INT] AS h FROM part) GROUP BY 1"""


def q_normalize_value(spark, d):
    value = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, VALUE_TAILS)), (F.col("p_partkey") % len(VALUE_TAILS) + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", normalize_values(value).alias("value"))


#: Units apart from their number, then capitals as usual; both lists are those of the rule, in the order of a search.
VALUE_UNITS = "mm|cm|dm(?:[²³])|km|ml|cl|dl|kg|mg|bar|psi|kw|mw|ka|ma|khz|mhz|ghz|hz|db|nm|lm|lux|an|mois|jour|inch|°|[mlgthswvan]\\b|min\\b|in\\b|ft\\b|yd\\b|lb\\b|oz\\b|gal\\b"
VALUE_USUAL = "KHZ kHz MHZ MHz GHZ GHz HZ Hz CM cm MM mm KM km KG kg MG mg ANS ans AN an MOIS mois BAR bar L l G g KW kw V v A a LB lb".split()


def value_sql() -> str:
    v = "CASE WHEN regexp_matches(v, 'E\\+02') THEN (p_size * 100)::BIGINT || regexp_replace(v, '^.*E\\+02', '') ELSE v END"
    v = f"regexp_replace({v}, {sql.quote(f'([0-9])({VALUE_UNITS})')}, '\\1 \\2', 'gi')"
    for shouted, usual in zip(VALUE_USUAL[::2], VALUE_USUAL[1::2], strict=True):
        v = f"regexp_replace({v}, '([0-9]\\s+){shouted}\\b', '\\1{usual}', 'g')"
    v = f"regexp_replace(regexp_replace({v}, '([0-9])\\s+a\\s+([0-9])', '\\1 à \\2', 'g'), 'Ø([0-9])', 'Ø \\1', 'g')"
    v = f"regexp_replace(regexp_replace({v}, '([0-9])\\s*([xX×])\\s*([0-9])', '\\1 \\2 \\3', 'g'), '\\s{{2,}}', ' ', 'g')"
    return f"SELECT p_partkey, {v} AS value FROM (SELECT p_partkey, p_size, p_size || [{', '.join(map(sql.quote, VALUE_TAILS))}][(p_partkey % {len(VALUE_TAILS)} + 1)::INT] AS v FROM part)"


VALUE_TAILS = ["cm", "x80x30", " KHZ", "m²", " a 12 bar", "E+02 cm", "kg", "-60cm", " ANS", "lb", "dm³", " MHZ", "x2 MOIS", "°C"]

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_strip_accents": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
    "q_normalize_section": f"SELECT doc_id, pos::INTEGER AS pos, {sql.section('line')} AS section_key FROM {sql.LINES}",
    "q_slugify": f"SELECT doc_id, pos::INTEGER AS pos, regexp_replace(regexp_replace(strip_accents(lower({sql.spell('line', L.SLUG_TRANSLITERATION)})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {sql.LINES}",
    "q_humanize_key": humanize_sql(),
    "q_clean_value": f"SELECT doc_id, pos::INTEGER AS pos, {CLEAN[0]} FROM (SELECT doc_id, pos, {CLEAN[1]} AS v FROM {sql.LINES})",
    "q_split_multi": SPLIT_SQL,
    "q_kv_split": KV_SQL,
    "q_color_code": COLOUR_SQL,
    "q_unit_detect": UNIT_SQL,
    "q_barcode": BARCODE_SQL,
    "q_legal_notice": LEGAL_SQL,
    "q_keyword_class": KEYWORD_SQL,
    "q_text_width": f"SELECT p_partkey, round(({width_sql('p_name')}) * p_size, 6) AS width FROM part",
    "q_safe_text": f"SELECT doc_id, {sql.spell('text', L.GLYPHS)} AS safe FROM documents",
    "q_dedup_hash": DEDUP_SQL,
    "q_url_basename": r"SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\]*)$', 1) AS base FROM pages",
    "q_delimiter": DELIMITER_SQL,
    "q_header_row": HEADER_SQL,
    "q_json_props": "SELECT event_type, count(props->>'$.k') AS n_k, sum((props->>'$.k')::INT)::BIGINT AS sum_k FROM events GROUP BY event_type",
    "q_key_style": STYLE_SQL,
    "q_spec_category": CATEGORY_SQL,
    "q_wrap_words": WRAP_SQL,
    "q_normalize_value": value_sql(),
}
