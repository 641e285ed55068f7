"""From cells of product tables to products: columns by role, technical ones left out, specs from the rest, assets by name, and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.signals import ROLES, family_ribbon, identifiers, is_technical_column, says
from pagewright.functions.text import clean_value, humanize_key, strip_accents, trim


def column_roles(headers: DataFrame, roles: dict[str, list[str]] | None = None) -> DataFrame:
    """path, role, header, col_idx: for each role the header that the first of its patterns finds first. headers: path, col_idx, header."""
    rules = [F.struct(F.lit(role).alias("role"), F.lit(rank).alias("rank"), F.lit(f"(?i){p}").alias("pattern")) for role, patterns in (roles or ROLES).items() for rank, p in enumerate(patterns)]
    rows = headers.select("path", "col_idx", "header", strip_accents(F.col("header")).alias("_plain"), F.explode(F.array(*rules)).alias("r"))
    found = rows.filter(F.regexp_like("_plain", F.col("r.pattern")))
    first = found.groupBy("path", F.col("r.role").alias("role")).agg(F.min(F.struct("r.rank", "col_idx", "header")).alias("f"))
    return first.select("path", "role", F.col("f.header").alias("header"), F.col("f.col_idx").alias("col_idx"))


def with_reply(found: DataFrame, reply: DataFrame, headers: DataFrame) -> DataFrame:
    """Roles that the patterns left open, filled from a model's reply (path, role, header) with headers that exist; nothing is overwritten."""
    known = reply.join(headers.select("path", "header", "col_idx"), ["path", "header"]).select("path", "role", "header", "col_idx")
    return found.unionByName(known.join(found.select("path", "role"), ["path", "role"], "left_anti").dropDuplicates(["path", "role"]))


def products(cells: DataFrame, roles: DataFrame, ribbons: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """A product for each row: path, row_idx, name, ref, color, image, section, family, specs (array of key, value, in the order of columns),
    identifiers. cells: path, row_idx, col_idx, header, value (long form); roles: column_roles().

    A row without name, reference and specs is no product. Values that say nothing are no specs; columns with a role and technical ones
    aren't either. The family is that of its column, else the section, as its ribbon. One shuffle by row.
    """
    role = roles.select("path", "header", F.col("role").alias("_role"))
    marked = cells.join(role.groupBy("path", "header").agg(F.collect_set("_role").alias("_roles")), ["path", "header"], "left")
    plain = strip_accents(F.col("header"))
    key = humanize_key(F.col("header"))
    value = clean_value(F.col("value"))
    spec = F.col("_roles").isNull() & ~is_technical_column(F.col("header")) & value.isNotNull() & (key != "")
    is_id = says(plain, ROLES["sku"][0])
    take = lambda name: F.max(F.when(F.array_contains("_roles", name), trim(F.col("value")))).alias(name)
    rows = marked.groupBy("path", "row_idx").agg(
        *[take(name) for name in ("name", "sku", "color", "image", "section", "family")],
        F.transform(F.array_sort(F.collect_list(F.when(spec, F.struct("col_idx", key.alias("key"), value.alias("value"))))), lambda s: F.struct(s["key"].alias("key"), s["value"].alias("value"))).alias("specs"),
        identifiers(F.transform(F.array_sort(F.collect_list(F.when(is_id, F.struct("col_idx", F.coalesce("value", F.lit("")).alias("v"))))), lambda s: s["v"])).alias("identifiers"),
    )
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    family = F.coalesce(family_ribbon(filled("family"), list(ribbons)), family_ribbon(filled("section"), list(ribbons)))
    out = rows.select("path", "row_idx", filled("name").alias("name"), filled("sku").alias("ref"), filled("color").alias("color"), filled("image").alias("image"), filled("section").alias("section"), family.alias("family"), "specs", "identifiers")
    return out.filter("name IS NOT NULL OR ref IS NOT NULL OR size(specs) > 0")


def asset_names(products: DataFrame) -> DataFrame:
    """path, row_idx, source_rank, id_rank, candidate: what an asset of a product may be called, best first: the image column, then identifiers
    with the longest in front, then the name."""
    base = F.regexp_extract(F.regexp_replace("image", r"[?#].*$", ""), r"([^/\\]*?)(?:\.[A-Za-z0-9]+)?$", 1)
    image = F.when(F.col("image").isNotNull(), F.array(F.struct(F.lit(0).alias("source_rank"), F.lit(0).alias("id_rank"), base.alias("candidate"))))
    ids = F.transform("identifiers", lambda v, i: F.struct(F.lit(1).alias("source_rank"), i.alias("id_rank"), v.alias("candidate")))
    name = F.when(F.col("name").isNotNull(), F.array(F.struct(F.lit(2).alias("source_rank"), F.lit(0).alias("id_rank"), F.col("name").alias("candidate"))))
    none = F.array().cast("array<struct<source_rank: int, id_rank: int, candidate: string>>")
    # An image column is the only source where it is filled.
    every = F.when(F.col("image").isNotNull(), image).otherwise(F.concat(F.coalesce(ids, none), F.coalesce(name, none)))
    return products.select("path", "row_idx", F.explode(every).alias("c")).select("path", "row_idx", "c.*").filter("candidate <> ''")


def best_assets(candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """path, row_idx, asset, tier: the first source, identifier and tier with an asset. assets: asset, asset_ord."""
    from pagewright.operators.joins import match_tiers

    names = candidates.select("candidate").distinct()
    met = match_tiers(names.withColumn("_id", F.col("candidate")), assets, "_id", "candidate", "asset", "asset_ord").filter("asset IS NOT NULL")
    rows = candidates.join(met.select(F.col("_id").alias("candidate"), "asset", "tier"), "candidate")
    first = rows.groupBy("path", "row_idx").agg(F.min(F.struct("source_rank", "id_rank", "tier", "asset")).alias("b"))
    return first.select("path", "row_idx", F.col("b.asset").alias("asset"), F.col("b.tier").alias("tier"))


def warnings(products: DataFrame, with_assets: DataFrame, most_unmatched: float = 0.3) -> DataFrame:
    """path, warning, n, detail: products without a name, references given twice (the first five by their first row), and whether so many products are
    without an asset that a model should be asked."""
    nameless = products.groupBy("path").agg(F.count_if(F.col("name").isNull()).alias("n")).filter("n > 0").select("path", F.lit("nameless").alias("warning"), "n", F.lit(None).cast("string").alias("detail"))
    twice = products.filter("ref IS NOT NULL").groupBy("path", "ref").agg(F.count(F.lit(1)).alias("c"), F.min("row_idx").alias("first")).filter("c > 1")
    listed = twice.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("first")))
    refs = listed.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "ref")))), lambda x: x["ref"]), ", ").alias("detail"))
    matched = with_assets.filter("asset IS NOT NULL").select("path", "row_idx", F.lit(1).alias("m"))
    share = products.select("path", "row_idx").join(matched, ["path", "row_idx"], "left").groupBy("path").agg(F.avg(F.when(F.col("m").isNull(), 1.0).otherwise(0.0)).alias("s"), F.count_if(F.col("m").isNull()).alias("n"))
    ask = share.filter(F.col("s") > most_unmatched).select("path", F.lit("ask for assets").alias("warning"), "n", F.lit(None).cast("string").alias("detail"))
    return nameless.unionByName(refs.select("path", F.lit("same reference").alias("warning"), "n", "detail")).unionByName(ask)


def should_infer(n_empty, n_all, n_sections):
    """Whether sections should be inferred: more than half of the products have none, and there are two to choose from."""
    return F.coalesce((n_all > 0) & (n_sections >= 2) & (n_empty / n_all > 0.5), F.lit(False))
