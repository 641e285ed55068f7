"""Templates as a whole: ribbons, dividers, tabular keys, contents pages, best profiles, signatures, and suggestions of a model made safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import has_key_value, trim
from pagewright.operators.folding import fold_groups

# Words of spec keys, and the forms of references, years and dates.
SPEC_WORDS = "MATIERE|MATIÈRE|LONGUEUR|DIAMETRE|DIAMÈTRE|GARANTIE|DURÉE|SUPPORT|CONDITIONNEMENT|ACCESSOIRES|FOURNIS|FINITION|RACCORD|DEBIT|DÉBIT"
REFERENCE, YEAR = r"\b(?:\d{4,7}\s+)?\d{6,8}\b", r"^(?:19|20)\d{2}$"
DATE = r"\b(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d{2}\b"
ISSUE_CATEGORIES = "overflow mismatch cropped missing_image overlap other".split()


def guard_zones(n_pages: Column) -> tuple[Column, Column]:
    """Pages at both ends that are never dividers: a tenth of the catalogue each, from 1 to 5."""
    zone = F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(n_pages * 0.1))).cast("int")
    return zone, zone


def is_ribbon(width: float, height: float, margin: float = 40.0, edge: float = 60.0) -> Column:
    """Whether a span (text, size, x0 ... y1) is a ribbon: upright at the left or right edge, or short and wide at the top or bottom."""
    w, h, t = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), trim(F.col("text"))
    upright = (h > w) & ((F.col("x1") < margin) | (F.col("x0") > width - margin))
    flat = (w > h) & (F.length(t) <= 40) & (F.col("size") >= 12) & (w >= width * 0.3) & ((F.col("y1") < edge) | (F.col("y0") > height - edge))
    return (F.length(t) >= 3) & (F.col("size") >= 8) & (upright | flat)


def pure_dividers(pages: DataFrame, spans: DataFrame, most_texts: int = 30) -> DataFrame:
    """Pages of kind intercalaire outside the guard zones, with little text and fewer than two spans that look like references or spec keys. pages:
    page, kind, n_pages; spans: page, text."""
    t = trim(F.col("text"))
    suspect = ~t.rlike(YEAR) & ~t.rlike(DATE) & (t.rlike(REFERENCE) | t.rlike(rf"(?iu)(?<![A-Za-z0-9_])({SPEC_WORDS})(?![A-Za-z0-9_])"))
    counts = spans.groupBy("page").agg(F.count_if(F.length(t) > 1).alias("texts"), F.count_if(suspect).alias("suspects"))
    first, last = guard_zones(F.col("n_pages"))
    rows = pages.filter((F.col("kind") == "intercalaire") & (F.col("page") >= first) & (F.col("page") <= F.col("n_pages") - 1 - last)).join(counts, "page", "left")
    return rows.filter((F.coalesce("texts", F.lit(0)) <= most_texts) & (F.coalesce("suspects", F.lit(0)) < 2)).select("page")


def tabular_keys(spans: DataFrame, width: float) -> DataFrame:
    """Keys in the left column of tables: first texts of lines with a wide gap after them, three or more of which share an x within 15 points of the
    first of them. spans: page, ord, text, x0, y0."""

    def fold(rows: list[dict]) -> list[dict]:
        clusters: list[list[dict]] = []
        for r in rows:
            for c in clusters:
                if abs(c[0]["x0"] - r["x0"]) <= 15:
                    c.append(r)
                    break
            else:
                clusters.append([r])
        best = max(clusters, key=len, default=[])
        return best if len(best) >= 3 else []

    t = trim(F.col("text"))
    line = Window.partitionBy("page", "_line")
    rows = spans.filter(t != "").withColumn("_line", F.floor(F.col("y0") / 2 + 0.5)).withColumn("_n", F.count(F.lit(1)).over(line))
    ordered = line.orderBy("x0", "ord")
    rows = rows.withColumn("_i", F.row_number().over(ordered)).withColumn("_x", F.lead("x0").over(ordered)).withColumn("_t", F.lead(t).over(ordered))
    wide = (F.col("_i") == 1) & (F.col("_n") >= 2) & F.length(t).between(3, 60) & ~t.rlike(r"^[\d.,\s]+$") & ~has_key_value(t) & (F.col("x0") <= width * 0.5) & (F.col("_x") - F.col("x0") >= 100)
    keys = rows.filter(wide & ~((F.col("_n") == 2) & F.col("_t").rlike(r"(?i)^p\.?\s*\d{1,4}\s*$"))).select("page", "ord", t.alias("text"), "x0", "y0")
    return fold_groups(keys, ["page"], ["y0", "ord"], "page long, ord string, text string, x0 double, y0 double", fold)


def best_contents(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Page of each group whose entries are many and long: n x min(mean length, 25), with three references and a mean of 8 at least; the first on
    ties. entries: keys, page, label, is_ref."""
    pages = entries.groupBy(*keys, "page").agg(F.count_if("is_ref").alias("refs"), F.count(F.lit(1)).alias("n"), F.avg(F.length(F.trim("label"))).alias("mean"))
    scored = pages.filter("refs >= 3 AND mean >= 8").withColumn("score", F.col("n") * F.least(F.col("mean"), F.lit(25.0)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "page"))
    return scored.withColumn("_r", rank).filter("_r = 1").select(*keys, "page", "score")


def best_profile(profiles: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Row with the largest value, the first on ties; not one that alone is far above the rest (1.5 medians, none within 90 percent of it) where
    there are three or more."""
    w = Window.partitionBy(*keys)
    rows = profiles.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(value, order))).withColumn("_top", F.max(value).over(w))
    rows = rows.withColumn("_median", F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col(value))).over(w)).withColumn("_near", F.count_if(F.col(value) >= F.col("_top") * 0.9).over(w))
    alone = (F.col("_n") >= 3) & (F.col("_top") > F.col("_median") * 1.5) & (F.col("_near") == 1)
    left = rows.filter(~(alone & (F.col(value) == F.col("_top"))))
    return left.withColumn("_k", F.row_number().over(w.orderBy(F.desc(value), order))).filter("_k = 1").select(*profiles.columns)


def signatures(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Text that tells templates apart: pages in all, and for the first six, spans, first fonts and sizes, and the five largest sizes in half points.
    spans: keys, page, ord, font, size."""
    rows = spans.withColumn("_p", F.dense_rank().over(Window.partitionBy(*keys).orderBy("page"))).withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "page").orderBy("ord")))
    n = rows.groupBy(*keys).agg(F.max("_p").alias("_pages"))
    name = F.concat_ws("/", "font", F.format_number("size", 1))
    listed = F.array_sort(F.collect_list(F.when(F.col("_i") <= 10, F.struct("_i", name.alias("s")))))
    sizes = F.slice(F.sort_array(F.collect_set(F.when(F.col("_i") <= 50, F.floor(F.col("size") * 2 + 0.5) / 2)), asc=False), 1, 5)
    pages = rows.filter("_p <= 6").groupBy(*keys, "_p").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(":"), F.array_join(F.transform(listed, lambda x: x["s"]), ","), F.lit(":["), F.array_join(F.transform(sizes, lambda x: F.format_number(x, 1)), ","), F.lit("]")).alias("s"))
    text = pages.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "s"))), lambda x: x["s"]), "|").alias("s"))
    return text.join(n, keys).select(*keys, F.concat(F.lit("n="), F.col("_pages"), F.lit("|"), F.col("s")).alias("signature"))


def contents_offsets(items: DataFrame, keys: list[str], first: float, step: float) -> DataFrame:
    """Height of each item of a contents page: even steps, and more room before headers but the first. items: keys, contents_page, position, kind."""
    w = Window.partitionBy(*keys, "contents_page").orderBy("position")
    i = F.row_number().over(w) - 1
    room = F.when(F.col("_i") == 0, 0.0).when(F.col("kind") == "family", step * 0.8).when(F.col("kind").isin("subfamily", "extra"), step * 0.35).otherwise(0.0)
    rows = items.withColumn("_i", i).withColumn("_room", room)
    total = F.sum("_room").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("y0", first + F.col("_i") * step + total).drop("_i", "_room")


def layout_specs(specs: Column) -> Column:
    """Specs (array of key and values) for a layout: empty ones go, the closing colon of a key too, values joined by a slash."""
    return F.transform(F.filter(specs, lambda s: F.size(s["values"]) > 0), lambda s: F.struct(F.regexp_replace(s["key"], r"\s*:\s*$", "").alias("key"), F.array_join(s["values"], " / ").alias("value")))


def safe_issues(replies: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues that a model reports (page, severity, category, description): without a known severity or a description they go; unknown categories are
    other, and unknown pages the first sampled one. pages: final_page, source_page, sample_ord."""
    first = pages.select(F.min_by("final_page", "sample_ord").over(Window.partitionBy(F.lit(0))).alias("f")).limit(1)  # sampled pages are a dozen
    rows = replies.filter(F.col("severity").isin("critical", "minor") & (F.coalesce("description", F.lit("")) != ""))
    rows = rows.withColumn("category", F.when(F.col("category").isin(ISSUE_CATEGORIES), F.col("category")).otherwise("other"))
    known = pages.select(F.col("final_page").alias("_k"))
    rows = rows.join(F.broadcast(known), F.col("page") == F.col("_k"), "left").join(F.broadcast(first)).withColumn("final_page", F.coalesce("_k", "f"))
    return rows.drop("_k", "f", "page").join(F.broadcast(pages.select("final_page", "source_page")), "final_page", "left")


def safe_intents(replies: DataFrame, fallback: float) -> DataFrame:
    """Edits that a model proposes (kind, target, confidence, fill, pad, to): those of known kinds with what they need; confidence within 0 and 1."""
    kind = F.col("kind")
    ok = F.col("target").isNotNull() & (kind.isin("move", "resize", "recolor") | ((kind == "erase_pad") & F.col("pad").isNotNull()) | ((kind == "replace_text") & F.col("to").isNotNull()))
    rows = replies.filter(F.coalesce(ok, F.lit(False)))
    return rows.withColumn("confidence", F.when(F.col("confidence").isNull(), F.lit(fallback)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))).withColumn("fill", F.when(F.col("fill").rlike("^#[0-9a-fA-F]{6}$"), F.col("fill")))


def stagnates(intents: DataFrame, turn: str) -> DataFrame:
    """Turns whose set of edits (kind, target) is that of the turn before: where a correction loop stops."""
    sets = intents.groupBy(turn).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "target"))), "|").alias("_s"))
    before = F.lag("_s").over(Window.partitionBy(F.lit(0)).orderBy(turn))  # one row a turn
    return sets.select(turn, F.coalesce(F.col("_s") == before, F.lit(False)).alias("same"))
