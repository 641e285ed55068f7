"""Driver tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line for every line of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, ord, x0, y0, x1, y1, size, font: order lines as text spans on a page, numbered from the top."""
    order = Window.partitionBy("page").orderBy("l_quantity", "l_discount", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x0, y0 = F.col("l_discount") * 1000, F.col("l_quantity") * 10
    # Numbered before the boxes are made, and by the page's own name: what follows by page needs no other exchange, and the one here has the table's columns only.
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page").withColumn("ord", F.row_number().over(order).cast("long"))
    return rows.select(
        "page", "ord", x0.alias("x0"), y0.alias("y0"),
        (x0 + 5 + F.col("l_tax") * 1000).alias("x1"), (y0 + 10).alias("y1"), (F.col("l_linenumber") + 8.0).alias("size"), F.col("l_returnflag").alias("font"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, model, event_type, status (error or ok), tokens: events as a log of calls."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("user_id") % 5).alias("model"), "event_type", F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.floor("value").cast("long").alias("tokens")
    )


def pick(key: str, values: list[str]):
    """One of the values, by a number in a column."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
