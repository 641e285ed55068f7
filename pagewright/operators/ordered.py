"""Computations along an order: filling forward, headers of a hierarchy, streaks, sliding windows, slots, greedy runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last value so far that isn't null or blank."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(F.trim(F.col(value)) != "", F.col(value)), ignorenulls=True).over(w))


def hierarchy_headers(df: DataFrame, keys: list[str], order: list[str], family: str, sub: str, label: str, other: str = "Autres") -> DataFrame:
    """keys, position, kind (family, subfamily or row), text: each row after the headers that change before it.

    A blank family gets the header `other` where a family was open before. A sub-family's header is shown where it differs from the
    last one shown in the same run of a family.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    fam, subf = F.nullif(F.trim(family), F.lit("")), F.nullif(F.trim(sub), F.lit(""))
    rows = df.withColumn("_f", fam).withColumn("_s", subf).withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_new", ~F.col("_f").eqNullSafe(F.lag("_f").over(w)) | (F.col("_i") == 1)).withColumn("_run", F.sum(F.col("_new").cast("int")).over(run))
    inside = Window.partitionBy(*keys, "_run").orderBy(*order)
    rows = rows.withColumn("_shown", F.last("_s", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    head = F.when(F.col("_new") & F.col("_f").isNotNull(), F.col("_f")).when(F.col("_new") & (F.col("_i") > 1), F.lit(other))
    subhead = F.when(F.col("_s").isNotNull() & ~F.col("_s").eqNullSafe(F.col("_shown")), F.col("_s"))
    parts = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("kind"), x.alias("text")) for i, (kind, x) in enumerate([("family", head), ("subfamily", subhead), ("row", F.col(label))])])
    out = rows.select(*keys, "_i", F.explode(F.filter(parts, lambda p: p["text"].isNotNull())).alias("p"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_i", "p.rank"))
    return out.select(*keys, place.cast("long").alias("position"), F.col("p.kind").alias("kind"), F.col("p.text").alias("text"))


def streaks(df: DataFrame, keys: list[str], order: list[str], hit: Column, reset: Column, out: str) -> DataFrame:
    """How many hits there have been since the last reset; other rows neither add nor reset."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_run", F.sum(reset.cast("int")).over(run))
    inside = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(hit.cast("long")).over(inside)).drop("_run")


def sliding(df: DataFrame, keys: list[str], micros: str, seconds: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over the rows of the last `seconds`, that many ago left out; micros: column of microseconds.

    Rows are worked on in stretches of that length, with the stretch before beside each, so that few keys make many tasks.
    """
    span = seconds * 1_000_000
    near = df.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_part", F.floor(F.col(micros) / span) + F.col("_copy"))
    w = Window.partitionBy(*keys, "_part").orderBy(micros).rangeBetween(-(span - 1), 0)
    return near.withColumns({name: a.over(w) for name, a in aggregates.items()}).filter("_copy = 0").drop("_copy", "_part")


def permute_slots(df: DataFrame, keys: list[str], order: str, movable: Column, by: list[Column]) -> DataFrame:
    """Movable rows dealt anew to the places that movable rows have, in the order `by`; the rest stays. New column: place."""
    rows = df.withColumn("_m", movable).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    slots = rows.filter("_m").withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))).select(*keys, "_k", F.col("_place").alias("place"))
    moved = rows.filter("_m").withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).join(slots, [*keys, "_k"]).drop("_k", "_m", "_place")
    still = rows.filter("NOT _m").withColumn("place", F.col("_place")).drop("_m", "_place")
    return moved.unionByName(still)


def anchored_groups(values: Column, tolerance: float) -> Column:
    """Sorted numbers in groups: a value joins the last group while it is within tolerance of the group's first value."""
    empty = F.array().cast("array<array<double>>")

    def step(groups: Column, x: Column) -> Column:
        last = F.element_at(groups, -1)
        joins = (F.size(groups) > 0) & (F.abs(x - last[0]) <= tolerance)
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(F.concat(last, F.array(x))))).otherwise(F.concat(groups, F.array(F.array(x))))

    return F.aggregate(F.array_sort(values), empty, step)
