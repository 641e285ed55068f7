"""From allocations to an ordered plan: pages per section, contents, technical grid, drawing order, plan documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Operations that only take away, drawn in the first pass.
ERASING = "erase_rect remove_text remove_paths".split()


def paginate(df: DataFrame, keys: list[str], section: str, order: str, per_page: int) -> DataFrame:
    """page (from 1 in each group of keys) and place: sections in order of their first row, each in pages of per_page."""
    inside = Window.partitionBy(*keys, section).orderBy(order)
    rows = df.withColumn("_first", F.min(order).over(Window.partitionBy(*keys, section))).withColumn("_i", F.row_number().over(inside) - 1)
    rows = rows.withColumn("_chunk", F.floor(F.col("_i") / per_page)).withColumn("place", (F.col("_i") % per_page).cast("int"))
    return rows.withColumn("page", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first", "_chunk")).cast("long")).drop("_first", "_i", "_chunk")


def technical_grid(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """grid_page, grid_row, grid_col: two columns and three rows a page."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("_i", i).withColumn("grid_page", F.floor(F.col("_i") / 6).cast("long")).withColumn("grid_row", F.floor(F.col("_i") % 6 / 2).cast("int")).withColumn("grid_col", (F.col("_i") % 2).cast("int")).drop("_i")


def drawing_order(ops: DataFrame) -> DataFrame:
    """Operations (page_ord, op_ord, op, no_erase) in the order in which they are drawn: all that erase before all that insert.
    An inserted text erases its place first, unless no_erase says not to, so it has a row in both passes."""
    erases = F.col("op").isin(ERASING)
    passes = F.when(erases, F.array(F.lit(1))).when((F.col("op") == "insert_text") & ~F.coalesce("no_erase", F.lit(False)), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    rows = ops.withColumn("pass", F.explode(passes))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("page_ord").orderBy("pass", "op_ord")).cast("long"))


def contents_pages(items: DataFrame, keys: list[str], per_page: int) -> DataFrame:
    """contents_page for items (keys, position, kind, text): chunks of per_page in which no header is the last item. One fold for each
    group, over its headers' positions."""
    schema = ", ".join([*[f"{k} {dict(items.dtypes)[k]}" for k in keys], "position long", "kind string", "text string", "contents_page int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position").reset_index(drop=True)
        kinds, pages, start, page = pdf["kind"].tolist(), [0] * len(pdf), 0, 1
        while start < len(kinds):
            end = min(start + per_page, len(kinds))
            if end < len(kinds) and kinds[end - 1] in ("family", "subfamily"):
                end = max(start + 1, end - 1)
            pages[start:end] = [page] * (end - start)
            start, page = end, page + 1
        return pdf.assign(contents_page=pages)[[*keys, "position", "kind", "text", "contents_page"]]

    return items.select(*keys, "position", "kind", "text").groupBy(*keys).applyInPandas(run, schema)


def plan_documents(ops: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document for each group of keys: version, pages with their operations in order, and counts."""
    page = ops.groupBy(*keys, "page_ord").agg(F.array_sort(F.collect_list(F.struct("op_ord", "op", "text"))).alias("operations"))
    doc = page.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_ord", "operations"))).alias("pages"), F.sum(F.size("operations")).alias("n_operations"))
    return doc.select(*keys, F.to_json(F.struct(F.lit(1).alias("version"), "pages", F.struct("n_operations", F.size("pages").alias("n_pages")).alias("stats"))).alias("plan"))
