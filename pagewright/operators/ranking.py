"""Ties broken by rule: top rows, majorities, upper medians, even samples, balanced parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group by an order that leaves no ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group that isn't blank; the one seen first (by order) on ties. Columns: keys, value, n."""
    counts = df.filter(F.trim(F.col(value).cast("string")) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return best(counts, keys, [F.desc("n"), F.asc("_first")]).drop("_first")


def upper_median(value: str) -> Column:
    """The value at floor(n / 2) of the sorted values; an aggregate that holds no array: it takes the exact discrete quantile."""
    return F.expr(f"element_at(array_sort(collect_list({value})), cast(floor(count({value}) / 2) as int) + 1)")


def upper_medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, median, n by rank in a window that can spill, so a hot key needs no array in memory."""
    rows = df.filter(F.col(value).isNotNull())
    ranked = rows.select(key, value, F.row_number().over(Window.partitionBy(key).orderBy(value)).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    return ranked.filter(F.col("_r") == F.floor(F.col("n") / 2) + 1).select(key, F.col(value).alias("median"), "n")


def even_sample(df: DataFrame, keys: list[str], order: list[Column], n: int, ends: bool = False) -> DataFrame:
    """n rows of each group spread evenly: the middles of n buckets, or with both ends."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if ends:
        spot = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / F.lit(max(1, n - 1)) + 0.5))
    else:
        spot = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor((k + 0.5) * F.col("_n") / n))
    return rows.filter((F.col("_n") <= n) | F.array_contains(spot, F.col("_i").cast("long"))).drop("_i", "_n")


def balanced_parts(df: DataFrame, keys: list[str], order: list[Column], parts: int) -> DataFrame:
    """part (from 1): groups in parts whose sizes differ by one at most, the larger ones first."""
    return df.withColumn("part", F.ntile(parts).over(Window.partitionBy(*keys).orderBy(*order)))
