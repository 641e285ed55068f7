"""Positioned text: bands, intervals, coverage, neighbours, page statistics. Pages are orders, spans are their lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators.joins import band_join, covered_share, in_interval, next_after
from pagewright.operators.ordered import anchored_groups, fill_forward
from pagewright.operators.validation import BOX, page_errors
from pagewright.queries import sql
from pagewright.queries.carriers import spans, table

#: Size of a page in points.
WIDTH, HEIGHT = 842.0, 595.0


def q_orientation_vote(spark, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind = F.when(w > h * 1.05, "landscape").when(h > w * 1.05, "portrait").otherwise("square")
    votes = spans(spark, d).groupBy("page").agg(*[F.count_if(kind == k).alias(k) for k in ("landscape", "portrait", "square")])
    best = F.when((F.col("portrait") > F.col("landscape")) & (F.col("portrait") >= F.col("square")), "portrait").when((F.col("square") > F.col("landscape")) & (F.col("square") > F.col("portrait")), "square").otherwise("landscape")
    return votes.withColumn("orientation", best)


ORIENTATION_SQL = f"""
WITH k AS (SELECT page, CASE WHEN x1 - x0 > (y1 - y0) * 1.05 THEN 'landscape' WHEN y1 - y0 > (x1 - x0) * 1.05 THEN 'portrait' ELSE 'square' END AS kind FROM {sql.SPANS}),
v AS (SELECT page, count(*) FILTER (WHERE kind = 'landscape') AS landscape, count(*) FILTER (WHERE kind = 'portrait') AS portrait, count(*) FILTER (WHERE kind = 'square') AS square FROM k GROUP BY page)
SELECT *, CASE WHEN portrait > landscape AND portrait >= square THEN 'portrait' WHEN square > landscape AND square > portrait THEN 'square' ELSE 'landscape' END AS orientation FROM v"""


def q_page_coverage(spark, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return spans(spark, d).groupBy("page").agg(F.round(F.least(F.lit(1.0), F.sum(area) / 5000.0), 9).alias("coverage"), F.round(F.max(area) / 5000.0, 9).alias("largest"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def q_page_score(spark, d):
    """Score of a page by its blocks: their number, specs, images and references."""
    blocks = spans(spark, d).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("size")).alias("specs"), F.avg((F.col("font") == "R").cast("double")).alias("images"), F.avg((F.col("x0") > 40).cast("double")).alias("refs"))
    score = F.least(F.lit(1.0), F.col("n") / 3) * 0.30 + F.least(F.lit(1.0), F.col("specs") / 5) * 0.30 + F.col("images") * 0.20 + F.col("refs") * 0.20
    return blocks.select("page", "n", F.round(score, 9).alias("score"))


def q_forward_fill(spark, d):
    """Section of each turn: the last banner so far in its conversation."""
    banner = F.when(F.col("role") == "user", F.substring("text", 1, 12))
    return fill_forward(table(spark, d, "conversations").withColumn("banner", banner), ["conv_id"], ["turn"], "banner", "section").select("conv_id", "turn", "section")


def q_block_bounds(spark, d):
    """Top and bottom of blocks: down to 4 points above the next one, or the page's margin."""
    w = Window.partitionBy("page").orderBy("y0", "ord")
    rows = spans(spark, d).withColumn("next_y", F.lead("y0").over(w))
    return rows.select("page", "ord", F.col("y0").alias("top"), F.coalesce(F.col("next_y") - 4, F.lit(HEIGHT - 30)).alias("bottom"), F.lead("y0", 1, 1e9).over(w).alias("next_key"))


def q_key_value_band(spark, d):
    """Values on the line of a key and to its right."""
    rows = spans(spark, d)
    keys = rows.filter("font = 'R'").select("page", F.col("ord").alias("key_ord"), F.col("y0").alias("key_y"), F.col("x1").alias("key_x1"))
    values = rows.filter("font <> 'R'").select("page", F.col("ord").alias("value_ord"), F.col("y0").alias("value_y"), F.col("x0").alias("value_x0"))
    return band_join(keys, values, ["page"], "key_y", "value_y", 30.0, also=F.col("value_x0") >= F.col("key_x1") - 1).select("page", "key_ord", "value_ord")


def q_next_row_asof(spark, d):
    return next_after(spans(spark, d), ["page"], "y0", "next_y", gap=4.0).select("page", "ord", "next_y")


def q_span_in_block(spark, d):
    """Spans whose top lies in the upper half of a block of their page."""
    rows = spans(spark, d)
    blocks = rows.filter("font = 'N'").select("page", F.col("ord").alias("block"), F.col("y0").alias("top"), (F.col("y0") + 120).alias("bottom"))
    return in_interval(rows.select("page", "ord", "y0"), blocks, ["page"], "y0", "top", "bottom").select("page", "ord", "block")


def q_residual_spans(spark, d):
    """Spans that no erased box of their page covers by 40 percent."""
    rows = spans(spark, d)
    erased = rows.filter("font = 'R'").select(F.col("page").alias("e_page"), (F.col("x0") - 20).alias("ex0"), (F.col("y0") - 20).alias("ey0"), (F.col("x1") + 20).alias("ex1"), (F.col("y1") + 20).alias("ey1"))
    covered = covered_share(("x0", "y0", "x1", "y1"), ("ex0", "ey0", "ex1", "ey1")) >= 0.4
    return rows.join(erased, (F.col("page") == F.col("e_page")) & covered, "left_anti").select("page", "ord")


RESIDUAL_SQL = f"""
WITH s AS (SELECT * FROM {sql.SPANS}), e AS (SELECT page, x0 - 20 AS ex0, y0 - 20 AS ey0, x1 + 20 AS ex1, y1 + 20 AS ey1 FROM s WHERE font = 'R')
SELECT page, ord FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page = s.page AND
  greatest(0, least(x1, ex1) - greatest(x0, ex0)) * greatest(0, least(y1, ey1) - greatest(y0, ey0)) / ((x1 - x0) * (y1 - y0)) >= 0.4)"""


def q_row_groups(spark, d):
    """Rows of a page: spans grouped by their distance to the row's first span."""
    pages = spans(spark, d).groupBy("page").agg(anchored_groups(F.collect_list("y0"), 60.0).alias("rows"))
    return pages.select("page", F.size("rows").cast("long").alias("n_rows"), F.array_max(F.transform("rows", lambda r: F.size(r))).cast("long").alias("longest"))


ROWS_SQL = f"""
WITH RECURSIVE s AS (SELECT page, y0, row_number() OVER (PARTITION BY page ORDER BY y0) AS i FROM {sql.SPANS}),
g AS (SELECT page, i, y0 AS anchor, 1 AS n FROM s WHERE i = 1
  UNION ALL SELECT s.page, s.i, CASE WHEN s.y0 - g.anchor <= 60 THEN g.anchor ELSE s.y0 END, CASE WHEN s.y0 - g.anchor <= 60 THEN g.n ELSE g.n + 1 END FROM g JOIN s ON s.page = g.page AND s.i = g.i + 1),
k AS (SELECT page, n, count(*) AS c FROM g GROUP BY 1, 2)
SELECT page, max(n)::BIGINT AS n_rows, max(c)::BIGINT AS longest FROM k GROUP BY page"""


def q_validate(spark, d):
    """Errors of spans with planted faults: path and message."""
    rows = spans(spark, d).withColumn("id", F.when(F.col("ord") % 97 == 0, "").otherwise(F.concat_ws("-", "page", "ord")))
    rows = rows.withColumn("size", F.when(F.col("page") % 31 == 0, -F.col("size")).otherwise(F.col("size"))).withColumn("x0", F.when(F.col("page") % 17 == 0, F.col("x1") + 1).otherwise(F.col("x0")))
    rows = rows.withColumn("color", F.when(F.col("page") % 13 == 0, "red").otherwise("#00ff7f")).withColumn("type", F.when(F.col("page") % 11 == 0, "blob").otherwise("product_slot")).withColumn("bbox", F.struct(*BOX))
    errors = rows.select("page", "ord", F.explode(page_errors()).alias("e")).select("page", "ord", "e.path", "e.message")
    return errors.groupBy("path", "message").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first_page"))


VALIDATE_SQL = f"""
WITH s AS (SELECT page, ord, CASE WHEN page % 17 = 0 THEN x1 + 1 ELSE x0 END AS x0, x1, page % 31 = 0 AS neg, page % 13 = 0 AS red, page % 11 = 0 AS blob, ord % 97 = 0 AS empty FROM {sql.SPANS}),
e AS (SELECT page, 'id' AS path, 'is empty' AS message FROM s WHERE empty UNION ALL SELECT page, 'type', 'is unknown' FROM s WHERE blob
  UNION ALL SELECT page, 'bbox', 'x0 is over x1' FROM s WHERE x0 > x1 UNION ALL SELECT page, 'color', 'is not #rrggbb' FROM s WHERE red UNION ALL SELECT page, 'size', 'is not above 0' FROM s WHERE neg)
SELECT path, message, count(*) AS n, min(page) AS first_page FROM e GROUP BY 1, 2"""

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_orientation_vote": ORIENTATION_SQL,
    "q_page_coverage": f"SELECT page, round(least(1.0, sum((x1 - x0) * (y1 - y0)) / 5000.0), 9)::DOUBLE AS coverage, round(max((x1 - x0) * (y1 - y0)) / 5000.0, 9) AS largest, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {sql.SPANS} GROUP BY page",
    "q_page_score": f"SELECT page, n, round(least(1.0, n / 3) * 0.30 + least(1.0, specs / 5) * 0.30 + images * 0.20 + refs * 0.20, 9)::DOUBLE AS score FROM (SELECT page, count(*) AS n, avg(size) AS specs, avg((font = 'R')::INT) AS images, avg((x0 > 40)::INT) AS refs FROM {sql.SPANS} GROUP BY page)",
    "q_forward_fill": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND trim(substr(text, 1, 12)) <> '' THEN substr(text, 1, 12) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations",
    "q_block_bounds": f"SELECT page, ord, y0 AS top, coalesce(lead(y0) OVER w - 4, {HEIGHT - 30})::DOUBLE AS bottom, lead(y0, 1, 1e9) OVER w AS next_key FROM {sql.SPANS} WINDOW w AS (PARTITION BY page ORDER BY y0, ord)",
    "q_key_value_band": f"WITH s AS (SELECT * FROM {sql.SPANS}) SELECT k.page, k.ord AS key_ord, v.ord AS value_ord FROM s k JOIN s v ON k.page = v.page AND k.font = 'R' AND v.font <> 'R' AND abs(k.y0 - v.y0) <= 30 AND v.x0 >= k.x1 - 1",
    "q_next_row_asof": f"WITH s AS (SELECT * FROM {sql.SPANS}) SELECT a.page, a.ord, min(b.y0) AS next_y FROM s a LEFT JOIN s b ON a.page = b.page AND b.y0 > a.y0 + 4 GROUP BY 1, 2",
    "q_span_in_block": f"WITH s AS (SELECT * FROM {sql.SPANS}) SELECT a.page, a.ord, b.ord AS block FROM s a JOIN s b ON a.page = b.page AND b.font = 'N' AND a.y0 >= b.y0 AND a.y0 < b.y0 + 120",
    "q_residual_spans": RESIDUAL_SQL,
    "q_row_groups": ROWS_SQL,
    "q_validate": VALIDATE_SQL,
}
