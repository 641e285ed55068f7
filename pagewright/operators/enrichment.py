"""Replies of a model as an input table: gates that decide whether to ask, validation of what comes back, and merging it in.

No model is called here; without replies all results are those of the rules alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import bare_key, has_unit


def parse_reply(text: Column) -> Column:
    """JSON of a reply as a variant: without code fences, else its first object, else its first list, else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"(?i)\s*```$", ""))
    part = lambda pattern: F.try_parse_json(F.regexp_extract(bare, pattern, 0))
    return F.coalesce(F.try_parse_json(bare), part(r"(?s)\{.*\}"), part(r"(?s)\[.*\]"))


def fill_gaps(rows: DataFrame, replies: DataFrame, key: str, value: str, known: DataFrame, known_value: str) -> DataFrame:
    """Rows with blank values filled from replies (key, reply) whose reply is a known value; what the rules found is never overwritten, and the
    first reply by order counts."""
    good = replies.join(known.select(F.col(known_value).alias("reply")).distinct(), "reply", "left_semi")
    first = good.groupBy(key).agg(F.min_by("reply", "reply_ord").alias("_reply"))
    own = F.when(F.trim(value) != "", F.col(value))
    return rows.join(first, key, "left").withColumn(value, F.coalesce(own, F.col("_reply"))).drop("_reply")


def key_gate(product_keys: DataFrame, template_keys: DataFrame, key: str) -> DataFrame:
    """One row: n_keys, mismatch (share of distinct product keys that no template key equals as letters and digits), suspect (share with an
    underscore), ask (both at least one half)."""
    template = template_keys.select(bare_key(F.col(key)).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    own = product_keys.select(key).distinct().withColumn("_k", bare_key(F.col(key))).join(template, "_k", "left")
    out = own.agg(F.count(F.lit(1)).alias("n_keys"), F.avg(F.col("_hit").isNull().cast("double")).alias("mismatch"), F.avg(F.col(key).contains("_").cast("double")).alias("suspect"))
    return out.withColumn("ask", F.coalesce((F.col("mismatch") >= 0.5) & (F.col("suspect") >= 0.5), F.lit(False)))


def format_mismatches(template: DataFrame, products: DataFrame, key: str, value: str) -> DataFrame:
    """key, mismatch: values of template and products differ by half in mean length (and by two characters), or only the template has units."""
    stats = lambda df, p: df.filter(F.trim(value) != "").groupBy(key).agg(F.avg(F.length(F.trim(value))).alias(f"{p}_len"), F.bool_or(has_unit(F.col(value))).alias(f"{p}_unit"))
    both = stats(template, "t").join(stats(products, "p"), key)
    longer = lambda a, b: (F.col(a) > F.col(b) * 1.5) & (F.col(a) - F.col(b) >= 2)
    return both.select(key, (longer("t_len", "p_len") | longer("p_len", "t_len") | (F.col("t_unit") & ~F.col("p_unit"))).alias("mismatch"))


def apply_rule(value: Column, rule: Column) -> Column:
    """A value in a rule's template: {value} or {n} stand for it, once. A rule whose own text the value has already leaves it as it is."""
    v = F.trim(value)
    plain = lambda x: F.regexp_replace(F.translate(F.lower(x), "²³", "23"), r"\s+", "")
    literal = plain(F.regexp_replace(rule, r"\{value\}|\{n\}", ""))
    has = rule.contains("{value}") | rule.contains("{n}")
    filled = F.concat(F.regexp_extract(rule, r"(?s)^(.*?)\{(?:value|n)\}(.*)$", 1), v, F.regexp_extract(rule, r"(?s)^(.*?)\{(?:value|n)\}(.*)$", 2))
    return F.when(v == "", v).when(rule.isNull(), v).when(~has, rule).when((literal != "") & plain(v).contains(literal), v).otherwise(filled)


def resolve_targets(intents: DataFrame, zones: DataFrame) -> DataFrame:
    """Intents (page, target) with the zone that their selector names, null if there is none. A selector is product_K.zone[.item_I[.part]]; without
    product_K it means product 0, or a zone of the page. zones: page, product (null for the page's own), zone, item (null), part (null), box."""
    steps = F.split("target", r"\.")
    numbered = steps[0].rlike("^product_[0-9]+$")
    rest = F.when(numbered, F.slice(steps, 2, 10)).otherwise(steps)
    item = F.regexp_extract(F.coalesce(F.get(rest, F.lit(1)), F.lit("")), "^item_([0-9]+)$", 1)
    rows = intents.withColumn("_product", F.when(numbered, F.regexp_extract(steps[0], "([0-9]+)$", 1).cast("int")).otherwise(0)).withColumn("_zone", F.get(rest, F.lit(0)))
    rows = rows.withColumn("_item", F.when(item != "", item.cast("int")).otherwise(-1)).withColumn("_part", F.when(F.col("_item") >= 0, F.coalesce(F.get(rest, F.lit(2)), F.lit("value"))).otherwise(""))
    z = zones.select(F.col("page").alias("_zp"), F.coalesce("product", F.lit(-1)).alias("_zproduct"), F.col("zone").alias("_zz"), F.coalesce("item", F.lit(-1)).alias("_zi"), F.coalesce("part", F.lit("")).alias("_zpart"), "box")
    same = (F.col("page") == F.col("_zp")) & (F.col("_zone") == F.col("_zz")) & (F.col("_item") == F.col("_zi")) & (F.col("_part") == F.col("_zpart"))
    own = rows.join(z, same & ((F.col("_product") == F.col("_zproduct")) | (F.col("_zproduct") == -1)), "left")
    return own.select(*intents.columns, "box")


def cascade(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """First answer of each request's attempts in order, if no attempt before it failed for good. attempts: keys, attempt, outcome (ok, skipped,
    quota, missing, server, or another error, which ends the request)."""
    ends = F.col("outcome").isin("ok") | ~F.col("outcome").isin("skipped", "quota", "missing", "server")
    first = attempts.filter(ends).groupBy(*keys).agg(F.min(F.struct("attempt", "outcome")).alias("s"))
    tried = attempts.groupBy(*keys).agg(F.max("attempt").alias("last"))
    return tried.join(first, keys, "left").select(*keys, F.coalesce("s.outcome", F.lit("exhausted")).alias("result"), F.coalesce("s.attempt", "last").alias("attempt"))
