"""Page analytics over positioned text: slots, banners, names, blocks, specs, images, kinds of pages.

Spans and boxes are columns x0, y0, x1, y1 from the top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import has_key_value, looks_like_barcode, page_keyword, trim
from pagewright.operators.folding import fold_groups

# Openings of section headers, in several languages.
SECTION_HEADERS = [
    r"CHECK-?LIST|LES\s*\+|OPTIONS?|ACCESSOIRES?|CARACT[ÉE]RISTIQUES|GAMMES?|NOS\s+(?:MARQUES|GAMMES|PRODUITS|SOLUTIONS)|BIEN\s+CHOISIR|COMMENT\s+CHOISIR|CONSEILS?|RÉCAPITULATIF|FOURNIS|CONSEILL[ÉE]S|INFOS?\s+PRODUITS?|DESCRIPTION",
    r"CHECKLIST|ACCESSORIES|OPTIONS?|FEATURES?|PRODUCT\s+(?:HIGHLIGHTS|INFO|DETAILS)|HOW\s+TO\s+CHOOSE|CHOOSE\s+YOUR|TIPS?|SPECIFICATIONS?|INCLUDED|SUPPLIED|HIGHLIGHTS",
    r"ZUBEHÖR|OPTIONEN?|EIGENSCHAFTEN|TIPPS?|MERKMALE|PRODUKTINFO|TECHNISCHE\s+DATEN",
    r"ACCESORIOS?|OPCIONES?|CARACTER[ÍI]STICAS|VENTAJAS|CONSEJOS?|DETALLES|INCLUIDO",
]
# Openings of catalogue subtitles, which may go on within the word.
SUBTITLES = r"POMPES?\s+(?:D\S|DE\s+|POUR\s+|À\s+)|AUTRE\s+POMPES?|APR[ÉE]S[-\s]VENTE|FORMATIONS?|AGR[ÉE]+|EAUX\s+(?:CLAIRES?|CHARG[ÉE]ES?|GRISES?|NOIRES?|US[ÉE]ES?)|GROUPES?\s+DE\s+(?:SURPRESSION|FILTRATION)"


def flipped(left: Column, bottom: Column, right: Column, top: Column, height: Column) -> Column:
    """Box with the origin at the top left from one with the origin at the bottom left."""
    return F.struct(left.alias("x0"), (height - top).alias("y0"), right.alias("x1"), (height - bottom).alias("y1"))


def is_page_number(x: Column) -> Column:
    bare = F.regexp_replace(x, r"\s", "")
    return (F.octet_length(bare) <= 6) & bare.rlike("^[0-9/.pP-]+$") & F.regexp_count(bare, F.lit("[0-9]")).between(1, 4)


def has_dot_leader(x: Column) -> Column:
    return x.contains("...") | x.contains(". . .")


def is_section_header(x: Column) -> Column:
    upper = F.upper(trim(x))
    return F.coalesce(upper.rlike(f"(?iu)^(?:{'|'.join(SECTION_HEADERS)})(?=$|[^A-Z])") | upper.rlike(f"(?iu)^(?:{SUBTITLES})"), F.lit(False))


def slot_type(text: Column, size: Column, width: float, height: float) -> Column:
    """Type of a text's slot by its place and size."""
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    share = y0 / height
    banner = (F.octet_length(F.btrim(text, F.lit(" \t"))) >= 6) & (((size >= 11) & (share < 0.25)) | ((x1 - x0 > width * 0.55) & (size >= 9) & (share < 0.60)))
    return F.when(banner, "section_banner").when((y1 > height - 40) & is_page_number(text), "page_number").when(has_dot_leader(text), "toc_entry").when((size >= 24) & (y0 < 200), "toc_title").otherwise("running_header")


def all_caps(x: Column) -> Column:
    return (x == F.upper(x)) & x.rlike("[A-ZÀ-Ý]")


def is_real_banner(text: Column, size: Column, banner_min: float, name_max: float) -> Column:
    t = trim(text)
    short = (F.length(t) >= 2) & all_caps(t) & (size >= name_max * 1.5)
    return (size >= banner_min) & ~has_key_value(text) & (size > name_max) & (F.length(t) <= 80) & ((F.length(t) >= 6) | short)


def section_labels(slots: DataFrame, banner_min: float = 11.0, name_max: float = 12.0) -> DataFrame:
    """page, section: the first real banner, else a banner in capitals at an edge, else a ribbon. slots: page, ord, type, text, size, x0, y0."""
    t, size = trim(F.col("text")), F.col("size")
    edge = (F.length(t).between(2, 80)) & ~has_key_value(t) & all_caps(t) & (((F.col("y0") < 50) & (size >= banner_min)) | ((F.col("x0") < 30) & (size >= 8)))
    priority = F.when((F.col("type") == "section_banner") & is_real_banner(F.col("text"), size, banner_min, name_max), 1).when((F.col("type") == "section_banner") & edge, 2).when((F.col("type") == "section_ribbon") & F.length(t).between(2, 80), 3)
    rows = slots.withColumn("_p", priority).withColumn("_t", t).filter("_p IS NOT NULL")
    return rows.groupBy("page").agg(F.min_by("_t", F.struct("_p", "ord")).alias("section"))


def page_kinds(pages: DataFrame) -> DataFrame:
    """kind and confidence of pages: n_blocks, n_refs, n_specs, n_images, min_name_size (of blocks), n_tiny_refs, n_toc_slots, n_page_refs, text, n_spans,
    n_labels, n_vectors, coverage, largest, max_size, section."""
    c = F.col
    dominant = (c("coverage") > 0.5) | (c("largest") > 0.35) | (c("min_name_size") > 24)
    cover = (c("n_blocks") > 0) & dominant & (c("n_refs") == 0) & (c("n_images") == 0) & (c("n_specs") < 3)
    intro = (c("n_blocks") > 0) & (c("n_refs") == 0) & (c("n_specs") < 5)
    product = (c("n_blocks") > 0) & ~F.coalesce(cover, F.lit(False)) & ~intro & (c("n_tiny_refs") < 6)
    glossary = (c("n_spans") >= 25) & (c("n_labels") >= 12) & (c("n_labels") / c("n_spans") >= 0.45) & (c("n_vectors") >= 50) & (c("n_vectors") >= 5 * c("n_labels"))
    word = page_keyword(c("text"))
    rules = [(product, F.lit("product"), 0.95), (c("n_toc_slots") > 0, F.lit("toc"), 0.9), (c("n_page_refs") >= 8, F.lit("toc"), 0.85), (word.isNotNull(), word, 0.85), (glossary, F.lit("glossaire"), 0.8), (c("section").isNotNull() & (c("coverage") < 0.4), F.lit("intercalaire"), 0.85)]
    kind, sure = F.lit("identity"), F.lit(0.7)
    for when, name, confidence in reversed(rules):
        kind, sure = F.when(when, name).otherwise(kind), F.when(when, confidence).otherwise(sure)
    return pages.withColumn("kind", kind).withColumn("confidence", sure)


def merged_names(names: Column, size_tolerance: float = 1.0, x_tolerance: float = 8.0, y_tolerance: float = 8.0, gap: float = 10.0) -> Column:
    """Names of a page (array of structs y0, x0, text, size, x1, y1) in reading order with split ones joined.

    A span joins the run before it if its size is that of the run's first span, and it stands below at the same x or beside at the same y of that span, close
    to the box of the run so far. Such a run depends on its own box, so this is a fold over the page, not a window.
    """
    run = lambda s, text, x1, y1: F.struct(s["y0"].alias("y0"), s["x0"].alias("x0"), text.alias("text"), s["size"].alias("size"), x1.alias("x1"), y1.alias("y1"))

    def step(runs: Column, s: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        below = (F.abs(s["x0"] - last["x0"]) < x_tolerance) & (s["y0"] - last["y1"] < y_tolerance)
        beside = (F.abs(s["y0"] - last["y0"]) < y_tolerance) & (s["x0"] - last["x1"] >= -2) & (s["x0"] - last["x1"] < gap)
        joins = F.coalesce((F.abs(s["size"] - last["size"]) < size_tolerance) & (below | beside), F.lit(False))
        grown = run(last, F.concat(last["text"], F.lit(" "), F.trim(s["text"])), F.greatest(last["x1"], s["x1"]), F.greatest(last["y1"], s["y1"]))
        return F.when(joins, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(runs, F.array(run(s, F.rtrim(s["text"]), s["x1"], s["y1"]))))

    kind = "array<struct<y0: double, x0: double, text: string, size: double, x1: double, y1: double>>"
    # Rows within one point of height are read from left to right.
    ordered = F.array_sort(names, lambda a, b: F.when(F.abs(a["y0"] - b["y0"]) > 1, F.signum(a["y0"] - b["y0"])).otherwise(F.signum(a["x0"] - b["x0"])).cast("int"))
    return F.aggregate(ordered, F.array().cast(kind), step)


def name_blocks(spans: DataFrame, *, sizes: tuple[float, float] = (9.0, 12.0), x_max: float = 400.0, height: float = 595.0, gap: float = 4.0, margin: float = 30.0) -> DataFrame:
    """page, name, top, bottom, left, right for each product name of a page: from its line to the next one, and on pages laid out in rows to the next
    name on the same row. spans: page, ord, text, size, x0, y0, x1, y1."""
    names = spans.filter(F.col("size").between(*sizes) & (F.col("x0") < x_max) & ~looks_like_barcode(F.col("text")) & ~is_section_header(F.col("text")))
    pages = names.groupBy("page").agg(merged_names(F.collect_list(F.struct("y0", "x0", "text", "size", "x1", "y1"))).alias("runs"))
    pages = pages.withColumn("n", F.size("runs")).withColumn("tol", F.greatest(F.lit(4.0), 0.30 * F.element_at(F.array_sort(F.transform("runs", lambda r: r["size"])), (F.floor(F.col("n") / 2) + 1).cast("int"))))
    rows = F.aggregate("runs", F.array().cast("array<struct<y: double, n: int>>"), lambda g, r: F.when(F.exists(g, lambda x: F.abs(x["y"] - r["y0"]) <= F.col("tol")), _count_first(g, r["y0"], F.col("tol"))).otherwise(F.concat(g, F.array(F.struct(r["y0"].alias("y"), F.lit(1).alias("n"))))))
    most = F.coalesce(F.array_max(F.transform(rows, lambda g: g["n"])), F.lit(0))
    pages = pages.withColumn("most", most)
    pages = pages.withColumn("in_rows", (F.col("n") >= 2) & (((F.col("most") >= 2) & (F.col("most") / F.col("n") >= 0.4)) | ((F.col("most") >= 3) & (F.col("most") / F.col("n") >= 0.33))))
    flat = pages.select("page", "in_rows", "tol", "runs", F.posexplode("runs").alias("pos", "r"))
    below = F.array_min(F.filter(F.transform("runs", lambda x: x["y0"]), lambda y: y - F.col("r.y0") > F.col("tol")))
    beside = F.array_min(F.transform(F.filter("runs", lambda x: (F.abs(x["y0"] - F.col("r.y0")) <= F.col("tol")) & (x["x0"] > F.col("r.x0"))), lambda x: x["x0"]))
    following = F.get(F.col("runs"), F.col("pos") + 1)["y0"]
    bottom = F.coalesce(F.when(F.col("in_rows"), below).otherwise(following) - gap, F.lit(height - margin))
    return flat.select("page", F.col("pos").alias("block"), F.col("r.text").alias("name"), F.col("r.y0").alias("top"), bottom.alias("bottom"), F.when(F.col("in_rows"), 0.0).otherwise(F.lit(-1e9)).alias("left"), F.when(F.col("in_rows"), F.coalesce(beside, F.lit(1e9))).otherwise(1e9).alias("right"))


def _count_first(groups: Column, y: Column, tolerance: Column) -> Column:
    first = F.array_position(F.transform(groups, lambda g: F.abs(g["y"] - y) <= tolerance), True)
    return F.transform(groups, lambda g, i: F.struct(g["y"].alias("y"), (g["n"] + (i + 1 == first).cast("int")).alias("n")))


def continuation_lines(lines: Column, key_bottom: Column, key_size: Column, key_y: Column, extra: float = 2.0, most: int = 5) -> Column:
    """Lines (array of structs y0, y1, text) below a key that carry on its value: each close to the one before, at most five, none too far below."""
    empty = F.struct(F.array().cast("array<string>").alias("texts"), F.lit(False).alias("done"), key_bottom.cast("double").alias("last"))

    def step(a: Column, v: Column) -> Column:
        stop = a["done"] | (v["y0"] - a["last"] > key_size + extra) | (F.size(a["texts"]) >= most) | (v["y0"] > key_y + most * (key_size + 2))
        return F.when(stop, F.struct(a["texts"].alias("texts"), F.lit(True).alias("done"), a["last"].alias("last"))).otherwise(F.struct(F.concat(a["texts"], F.array(v["text"])).alias("texts"), F.lit(False).alias("done"), v["y1"].cast("double").alias("last")))

    return F.aggregate(F.array_sort(lines), empty, step, lambda a: a["texts"])


def main_images(images: DataFrame, keys: list[str], page_width: float, specs_x: float, picto: float) -> DataFrame:
    """Best image of each block: large and not drawn out, left of the specs, no strip and no background. images: keys, ord, x0 ... y1, top, bottom."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    block = F.col("bottom") - F.col("top")
    strip = (w > page_width * 0.5) & (h < picto * 2)
    background = ((h > block * 0.9) & (w > page_width * 0.6)) | ((F.col("y0") - F.col("top") < 2) & (F.col("bottom") - F.col("y1") < 2))
    fit = (F.col("x0") < specs_x) & (F.col("y0") >= F.col("top")) & (F.col("y0") < F.col("bottom")) & (w >= picto) & (h >= picto) & ~strip & ~background
    ratio = F.greatest(w / h, h / w)
    scored = images.filter(fit).withColumn("score", w * h * (1 - F.least(F.lit(0.5), (ratio - 1) * 0.05)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
    return scored.withColumn("_r", rank).filter("_r = 1").select(*keys, "ord", "score")


def overflow_blocks(blocks: DataFrame, wanted: Column, height: float, gap: float = 8.0, footer: float = 30.0) -> DataFrame:
    """Blocks that still fit below a page's lowest block: as many as products are left over. blocks: page, n_blocks, top, bottom (of the lowest)."""
    step = F.col("bottom") - F.col("top") + gap
    room = F.floor((height - footer - F.col("bottom")) / step)
    n = F.least(room, wanted - F.col("n_blocks"))
    rows = blocks.withColumn("n", n.cast("int")).filter((F.col("bottom") > F.col("top")) & (F.col("n") > 0))
    return rows.select("page", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "top", "bottom").select("page", "i", (F.col("top") + F.col("i") * (F.col("bottom") - F.col("top") + gap)).alias("top"), (F.col("bottom") + F.col("i") * (F.col("bottom") - F.col("top") + gap)).alias("bottom"))


def merge_ribbons(boxes: list[tuple[float, float, float, float]], width: float, height: float, tolerance: float = 4.0, share: float = 0.7) -> list[tuple[float, float, float, float]]:
    """Ribbons that lie on one line, joined with the first that stays under a share of the page."""
    out: list[tuple[float, float, float, float]] = []
    for box in boxes:
        flat = box[2] - box[0] > box[3] - box[1]
        for i, other in enumerate(out):
            union = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]))
            start, long, page = (1, union[2] - union[0], width) if flat else (0, union[3] - union[1], height)
            if flat == (other[2] - other[0] > other[3] - other[1]) and abs(box[start] - other[start]) <= tolerance and long <= page * share:
                out[i] = union
                break
        else:
            out.append(box)
    return out


def ribbons(spans: DataFrame, width: float, height: float) -> DataFrame:
    """page, x0, y0, x1, y1 of merged ribbons: a greedy fold in reading order, page by page. spans: page, ord, x0, y0, x1, y1."""

    def fold(rows: list[dict]) -> list[dict]:
        merged = merge_ribbons([(r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows], width, height)
        return [{"page": rows[0]["page"], "x0": a, "y0": b, "x1": c, "y1": d} for a, b, c, d in merged]

    return fold_groups(spans.select("page", "ord", "x0", "y0", "x1", "y1"), ["page"], ["ord"], "page long, x0 double, y0 double, x1 double, y1 double", fold)


def page_hash(spans: DataFrame, n: int = 20) -> DataFrame:
    """page, content_hash of the first n texts in reading order, heights within half a point being one line."""
    line = F.floor(F.col("y0") / 0.5)
    texts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(line.alias("l"), "x0", "ord", F.trim("text").alias("t")))), 1, n), lambda s: s["t"])
    return spans.filter(F.trim("text") != "").groupBy("page").agg(F.sha2(F.array_join(texts, "|"), 256).alias("content_hash"))
