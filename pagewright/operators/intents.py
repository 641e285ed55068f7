"""Semantic edits of pages: the zones that a page offers, the edits that put products into its blocks, and the drawing operations they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import safe_text, text_width, trim

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
#: A zone: where it is, whether it is text, and then its style and text.
ZONE = f"struct<target: string, box: {BOX}, is_text: boolean, size: double, font: string, color: string, text: string>"


def zone(target: Column, box: Column, text: Column | None = None, size: Column | None = None, font: Column | None = None, color: Column | None = None) -> Column:
    some = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(target.alias("target"), box.cast(BOX).alias("box"), F.lit(text is not None).alias("is_text"), some(size, "double").alias("size"), some(font, "string").alias("font"), some(color, "string").alias("color"), some(text, "string").alias("text"))


def text_zone(target: Column, s: Column) -> Column:
    return zone(target, s["box"], s["text"], s["size"], s["font"], s["color"])


def spec_value(s: Column) -> Column:
    """A spec's value, or an empty one in the place of its key."""
    return F.coalesce(s["value"], F.struct(s["key"]["box"].alias("box"), F.lit("").alias("text"), s["key"]["size"].alias("size"), s["key"]["font"].alias("font"), s["key"]["color"].alias("color")))


def around(boxes: Column) -> Column:
    """The box around an array of boxes."""
    side = lambda name, f: f(F.transform(boxes, lambda b: b[name])).alias(name)
    return F.struct(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))


def page_schema(blocks: DataFrame) -> DataFrame:
    """A row for each zone of each page: page, target, box, is_text, size, font, color, text.

    blocks: page, block (from 0), title, reference, color (each a struct of box, text, size, font, color, or null), image (a box, or
    null) and specs (an array of structs key and value, like title). Zones are page_N.product_i.zone; those of the first block
    also page_N.zone. A spec without a value has an empty one in the place of its key.
    """
    of = lambda prefix, name: F.concat(prefix, F.lit(f".{name}"))

    def zones(prefix: Column) -> Column:
        single = [F.when(F.col(c).isNotNull(), text_zone(of(prefix, c), F.col(c))) for c in ("title", "reference", "color")]
        image = F.when(F.col("image").isNotNull(), zone(of(prefix, "image_main"), F.col("image")))
        specs = F.coalesce("specs", F.array())
        item = lambda i: F.concat(prefix, F.lit(".specs_block.item_"), i.cast("string"))
        items = F.flatten(F.transform(specs, lambda s, i: F.array(text_zone(F.concat(item(i), F.lit(".key")), s["key"]), text_zone(F.concat(item(i), F.lit(".value")), spec_value(s)), text_zone(item(i), spec_value(s)))))
        boxes = F.flatten(F.transform(specs, lambda s: F.array(s["key"]["box"], spec_value(s)["box"])))
        whole = F.when(F.size(specs) > 0, zone(of(prefix, "specs_block"), around(boxes)))
        return F.concat(F.filter(F.array(*single, image, whole).cast(f"array<{ZONE}>"), lambda z: z.isNotNull()), items.cast(f"array<{ZONE}>"))

    page = F.concat(F.lit("page_"), F.col("page").cast("string"))
    own = zones(F.concat(page, F.lit(".product_"), F.col("block").cast("string")))
    every = F.when(F.col("block") == 0, F.concat(own, zones(page))).otherwise(own)
    return blocks.select("page", F.explode(every).alias("z")).select("page", "z.*")


#: An edit; place is the column of the block that it names, or null where it names the spec of that index.
INTENT = "struct<op: string, target: string, text: string, key: string, value: string, image_path: string, place: string, item: int>"
PRODUCT = ("name", "ref", "shade", "image_path", "new_specs")


def intent(op: str, target: Column, place: str | Column, **values: Column) -> Column:
    at = [F.lit(place).alias("place"), F.lit(None).cast("int").alias("item")] if isinstance(place, str) else [F.lit(None).cast("string").alias("place"), place.cast("int").alias("item")]
    return F.struct(F.lit(op).alias("op"), target.alias("target"), *[values.get(n, F.lit(None)).cast("string").alias(n) for n in ("text", "key", "value", "image_path")], *at)


def product_intents(blocks: DataFrame, products: DataFrame) -> DataFrame:
    """page, block, seq, op, target, text, key, value, image_path: the edits that put the products of a page into its blocks, in order.

    blocks as in page_schema(); products: page, block, name, ref, shade, image_path, new_specs (array of structs key, values). A block
    without a product loses all it has. Specs take the places of the block's; those left over go, and so does an image that the
    product has none for. Targets name the block where a page has several.
    """
    p = products.select("page", "block", F.struct(*PRODUCT).alias("product"))
    rows = blocks.withColumn("_n", page_blocks()).join(p, ["page", "block"], "left")
    return edits(rows).select("page", "block", "seq", "op", "target", "text", "key", "value", "image_path")


def page_blocks() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("page"))


def edits(rows: DataFrame, *keep: str) -> DataFrame:
    """page, block, what is to be kept, seq and the edits of product_intents(). rows: blocks with their page's number of blocks (_n) and a struct product, null without one."""
    rows = rows.withColumns({n: F.col("product")[n] for n in PRODUCT}).withColumn("_product", F.col("product").isNotNull())
    prefix = F.concat(F.lit("page_"), F.col("page").cast("string"), F.when(F.col("_n") > 1, F.concat(F.lit(".product_"), F.col("block").cast("string"))).otherwise(""))
    rows = rows.withColumn("_pfx", prefix).withColumn("_old", F.coalesce(F.size("specs"), F.lit(0)))
    rows = rows.withColumn("_old", F.greatest("_old", F.lit(0))).withColumn("_new", F.greatest(F.coalesce(F.size("new_specs"), F.lit(0)), F.lit(0)))
    at = lambda name: F.concat(F.col("_pfx"), F.lit(f".{name}"))
    item = lambda i: F.concat(F.col("_pfx"), F.lit(".specs_block.item_"), i.cast("string"))
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    only = lambda when, x: F.when(when, x)
    gone = lambda first: F.when(F.col("_old") > first, F.transform(F.sequence(first, F.col("_old") - 1), lambda i: intent("remove_element", item(i), i))).otherwise(F.array().cast(f"array<{INTENT}>"))
    kept = F.least("_old", "_new")
    empty = F.concat(
        F.array(intent("remove_element", at("title"), "title"), *[only(F.col(c).isNotNull(), intent("remove_element", at(n), c)) for c, n in (("reference", "reference"), ("color", "color"), ("image", "image_main"))]).cast(f"array<{INTENT}>"),
        gone(F.lit(0)),
    )
    put = [only(given(c), intent("replace_text", at(n), n, text=F.col(c))) for c, n in (("name", "title"), ("ref", "reference"), ("shade", "color"))]
    image = F.when(given("image_path"), intent("swap_image", at("image_main"), "image", image_path=F.col("image_path"))).when(F.col("image").isNotNull(), intent("remove_element", at("image_main"), "image"))
    updates = F.transform(F.slice(F.coalesce("new_specs", F.array()), F.lit(1), kept), lambda s, i: intent("update_spec", item(i), i, key=s["key"], value=F.array_join(F.coalesce(s["values"], F.array()), ", ")))
    filled = F.concat(F.array(*put, image).cast(f"array<{INTENT}>"), F.when(kept > 0, updates.cast(f"array<{INTENT}>")).otherwise(F.array().cast(f"array<{INTENT}>")), gone(kept))
    # In a projection of its own the array is compiled; within the generator it would be interpreted.
    rows = rows.withColumn("_every", F.when(F.col("_product"), filled).otherwise(empty))
    rows = rows.select("page", "block", *keep, F.posexplode(F.filter("_every", lambda x: x.isNotNull())).alias("seq", "e")).select("page", "block", *keep, "seq", "e.*")
    # All glyphs are beyond ASCII. Through transform() the rule is written once; three times in a row's code it is too long to be compiled.
    spelled = F.transform(F.array("text", "key", trim(F.col("value"))), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), safe_text(x)).otherwise(x))
    rows = rows.withColumn("_spelled", spelled)
    return rows.withColumns({n: F.col("_spelled")[i] for i, n in enumerate(("text", "key", "value"))}).drop("_spelled")


OPERATION = f"struct<op: string, box: {BOX}, text: string, font: string, size: double, color: string, image_path: string, reason: string>"


def resolved(intents: DataFrame, schema: DataFrame) -> DataFrame:
    """page, intent columns id, and for each edit its operations in order: op, box, text, font, size, color, image_path; or a row with a
    reason and no op, where it can't be done.

    intents: page, id, op, target, text, key, value, image_path, fill; schema: page_schema(). A text is erased with 2 points around,
    or as far to the right as the new text reaches, and drawn again in its style.
    """
    zones = schema.select("page", F.col("target").alias("_t"), F.struct("box", "is_text", "size", "font", "color", "text").alias("zone")).dropDuplicates(["page", "_t"])
    own = lambda suffix, name: zones.select("page", F.col("_t").alias(f"_{name}"), F.col("zone").alias(name))
    rows = intents.withColumn("_zone", F.col("target")).withColumn("_kzone", F.concat("target", F.lit(".key"))).withColumn("_vzone", F.concat("target", F.lit(".value")))
    for name in ("zone", "kzone", "vzone"):
        rows = rows.join(own("", name), ["page", f"_{name}"], "left")
    return operations(rows, "page", "id")


def resolved_products(blocks: DataFrame) -> DataFrame:
    """page, block, intent, seq and operations: what resolved() makes of product_intents() and page_schema(), where each block has its product
    beside it (a struct product, null without one).

    Such edits name zones of their own block only, so these are taken from its row: no zone is written out or looked up by its target,
    and rows leave their page's partition only as operations.
    """
    parts = ("title", "reference", "color", "image", "specs")
    rows = edits(blocks.withColumn("_n", page_blocks()), "_n", *parts)
    # Zones without their block's number are those of the first block.
    named = F.col("target").isNotNull() & ((F.col("_n") > 1) | (F.col("block") == 0))
    of_spec = lambda part: F.transform(F.array(F.get("specs", F.col("item"))), lambda s: text_zone(F.col("target"), part(s)))[0]
    zone_at = F.when(F.col("item").isNotNull(), of_spec(spec_value))
    for c in parts[:3]:
        zone_at = zone_at.when((F.col("place") == c) & F.col(c).isNotNull(), text_zone(F.col("target"), F.col(c)))
    zone_at = zone_at.when((F.col("place") == "image") & F.col("image").isNotNull(), zone(F.col("target"), F.col("image")))
    update = named & F.col("item").isNotNull() & (F.col("op") == "update_spec")
    rows = rows.withColumns({"zone": F.when(named, zone_at), "kzone": F.when(update, of_spec(lambda s: s["key"])), "vzone": F.when(update, of_spec(spec_value)), "fill": F.lit(None).cast("string")})
    return operations(rows.withColumnRenamed("seq", "intent"), "page", "block", "intent")


def operations(rows: DataFrame, *keep: str) -> DataFrame:
    """What is to be kept, seq and the operations of each edit. rows: op, text, key, value, image_path, fill, and the zones that target, key
    and value name (zone, kzone, vzone). A text is measured once."""
    op, z = F.col("op"), F.col("zone")
    said = F.when(op == "replace_text", F.col("text")).when(op == "update_spec", F.col("value")).when(op == "set_color", z["text"])
    rows = rows.withColumns({"_said": said, "_size": F.when(op == "update_spec", F.col("vzone.size")).otherwise(z["size"]), "_key": F.when(op == "update_spec", F.col("key")), "_ksize": F.col("kzone.size")})
    rows = rows.withColumns({"_wide": text_width(F.col("_said"), F.col("_size")), "_kwide": text_width(F.col("_key"), F.col("_ksize"))})
    grown = lambda b, by: F.struct((b["x0"] - by).alias("x0"), (b["y0"] - by).alias("y0"), (b["x1"] + by).alias("x1"), (b["y1"] + by).alias("y1"))

    def operation(op: str | None, box=None, reason=None, **v) -> Column:
        some = lambda n, kind: v.get(n, F.lit(None)).cast(kind).alias(n)
        return F.struct(F.lit(op).cast("string").alias("op"), (F.lit(None) if box is None else box).cast(BOX).alias("box"), some("text", "string"), some("font", "string"), some("size", "double"), some("color", "string"), some("image_path", "string"), F.lit(reason).cast("string").alias("reason"))

    def drawn(r: Column) -> Column:
        b = r["box"]
        reach = F.struct((b["x0"] - 2).alias("x0"), (b["y0"] - 2).alias("y0"), (b["x0"] + r["wide"] + 4).alias("x1"), (b["y1"] + 2).alias("y1"))
        erased = F.when(r["wide"] > b["x1"] - b["x0"], reach).otherwise(grown(b, 2))
        return F.array(operation("erase_rect", erased), operation("insert_text", b, text=r["text"], font=r["font"], size=r["size"], color=r["color"]))

    def replaced(z: Column, text: Column, width: str = "_wide", color: Column | None = None) -> Column:
        r = F.struct(z["box"].alias("box"), text.alias("text"), z["size"].alias("size"), z["font"].alias("font"), (z["color"] if color is None else color).alias("color"), F.col(width).alias("wide"))
        return F.transform(F.array(r), drawn)[0]  # written once, as above

    def or_reason(z: Column, ops: Column, reason: str) -> Column:
        return F.when(F.coalesce(z["is_text"], F.lit(False)), ops).otherwise(F.array(operation(None, reason=reason)))

    none = F.array().cast(f"array<{OPERATION}>")
    update = F.concat(F.when(F.col("key").isNotNull(), or_reason(F.col("kzone"), replaced(F.col("kzone"), F.col("key"), "_kwide"), "no key there")).otherwise(none), or_reason(F.col("vzone"), replaced(F.col("vzone"), F.col("value")), "no value there"))
    # A spec's item is there if its value is.
    there = F.when(F.col("op") == "update_spec", F.col("vzone").isNotNull()).otherwise(z.isNotNull())
    ops = (
        F.when(~there, F.array(operation(None, reason="no such target")))
        .when(F.col("op") == "replace_text", or_reason(z, replaced(z, F.col("text")), "not a text"))
        .when(F.col("op") == "swap_image", F.array(operation("erase_rect", grown(z["box"], 2)), operation("draw_image", z["box"], image_path=F.col("image_path"))))
        .when(F.col("op") == "update_spec", update)
        .when(F.col("op") == "set_color", or_reason(z, replaced(z, z["text"], color=F.col("fill")), "not a text"))
        .when(F.col("op") == "remove_element", F.array(operation("erase_rect", grown(z["box"], 2))))
        .otherwise(none)
    )
    rows = rows.withColumn("_ops", ops.cast(f"array<{OPERATION}>"))
    # Of a plain posexplode() Spark infers a filter that makes the array once more.
    return rows.select(*keep, F.posexplode_outer("_ops").alias("seq", "o")).filter("seq IS NOT NULL").select(*keep, "seq", "o.*")


def loop_ends(turns: DataFrame, most: int = 2, budget: float = 1.0) -> DataFrame:
    """Turns of a correction loop with whether they run: turn, n_intents, n_ops, cost, same (as stagnates() says) of each in its order.

    A turn runs if all before it ran on: there are at most `most`; the cost so far is under the budget; the turn before had edits that
    became operations, and was not the same as the one before it.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)  # a few turns
    stopped = F.coalesce(F.max((F.col("n_intents") == 0) | (F.col("n_ops") == 0) | F.col("same")).over(before), F.lit(False))
    spent = F.coalesce(F.sum("cost").over(before), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("turn"))
    return turns.withColumn("runs", (place <= most) & (spent < budget) & ~stopped)
