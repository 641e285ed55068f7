"""Where a block of a page reaches, what lies behind a label, and what a rectangle takes away. Boxes are columns x0, y0, x1, y1 from the top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def padded(prefix: str, by: float) -> list[Column]:
    """A box grown by so much on all sides."""
    return [(F.col(f"{prefix}{s}") + (by if s.endswith("1") else -by)).alias(s) for s in SIDES]


def block_zones(blocks: DataFrame, page_width: float, page_height: float, ribbon: float) -> DataFrame:
    """page, block, x0, y0, x1, y1: the zone of each block. blocks: page, block, top, bottom, name_x0, specs_x0.

    Above it takes half of the gap to the nearest block that ends before it, between 4 and 12 points; the lowest block of a page reaches
    down to the footer, others 4 points on. One window a page.
    """
    page = Window.partitionBy("page")
    ends = F.collect_list("bottom").over(page)
    before = F.array_max(F.filter(F.col("_ends"), lambda b: b < F.col("top")))
    last = F.row_number().over(page.orderBy(F.desc("top"), F.desc("block"))) == 1
    rows = blocks.withColumn("_ends", ends).withColumn("_last", last).withColumn("_gap", F.col("top") - F.coalesce(before, F.lit(0.0)))
    above = F.least(F.lit(12.0), F.greatest(F.lit(4.0), F.col("_gap") / 2 - 1))
    down = F.col("bottom") + 4
    return rows.select("page", "block", (F.least("name_x0", "specs_x0") - 4).alias("x0"), (F.col("top") - above).alias("y0"), F.lit(page_width - ribbon).alias("x1"), F.when(F.col("_last"), F.greatest(down, F.lit(page_height - 30.0))).otherwise(down).alias("y1"))


def backgrounds(labels: DataFrame, paths: DataFrame, page_width: float, page_height: float, kind: str) -> DataFrame:
    """page, label, path: the first path that carries a label, null without one. labels: page, label, x0 ...; paths: page, path, x0 ...

    kind: banner (paths half as wide as the page) or ribbon (lying ones a fifth of the page wide and under 60 high, standing ones under
    50 wide and a quarter of the page high); a path holds its label with 2 (banner) or 4 (ribbon) points to spare.
    """
    p = paths.select(F.col("page").alias("_page"), "path", *[F.col(s).alias(f"p_{s}") for s in SIDES])
    spare = 2 if kind == "banner" else 4
    holds = (F.col("p_x0") - spare <= F.col("x0")) & (F.col("p_x1") + spare >= F.col("x1")) & (F.col("p_y0") - spare <= F.col("y0")) & (F.col("p_y1") + spare >= F.col("y1"))
    w, h = F.col("p_x1") - F.col("p_x0"), F.col("p_y1") - F.col("p_y0")
    if kind == "banner":
        shape = w >= page_width * 0.5
    else:
        lying = F.col("x1") - F.col("x0") > F.col("y1") - F.col("y0")
        shape = F.when(lying, (w >= page_width * 0.2) & (h < 60)).otherwise((w < 50) & (h >= page_height * 0.25))
    met = labels.join(p, F.col("page") == F.col("_page")).filter(shape & holds).groupBy("page", "label").agg(F.min("path").alias("path"))
    return labels.select("page", "label").join(met, ["page", "label"], "left")


def left_after_removal(things: DataFrame, rects: DataFrame, most: float = 1500.0) -> DataFrame:
    """Things (page, thing, x0 ...) that stay once rectangles (page, x0 ...) have taken away what lies within them, give or take a point, and has
    an area of `most` at most."""
    r = rects.select(F.col("page").alias("_page"), *[F.col(s).alias(f"r_{s}") for s in SIDES])
    inside = (F.col("x0") >= F.col("r_x0") - 1) & (F.col("x1") <= F.col("r_x1") + 1) & (F.col("y0") >= F.col("r_y0") - 1) & (F.col("y1") <= F.col("r_y1") + 1)
    small = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= most
    return things.join(r, (F.col("page") == F.col("_page")) & inside & small, "left_anti")
