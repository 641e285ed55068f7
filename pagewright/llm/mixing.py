"""Mixing sources to target weights: capped water-filling over source sizes, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Words of a text: its [^\\x20\\x09-\\x0D]+ runs; null has none. Counted as starts of words, without building them."""
    padded = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    trimmed = F.btrim(padded)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(" +")) + 1).cast("long")


def source_weights(sizes: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """sizes (source, source_size) with weight: the cycle's values by rank of source, by code point, null last.

    The rank comes from a range partitioning and the row counts of its partitions, so no task sees all sources.
    """
    spark = sizes.sparkSession
    ordered = sizes.withColumn("no_source", F.col("source").isNull())
    ordered = materialize(ordered.repartitionByRange("no_source", "source").withColumn("part", F.spark_partition_id()), "sources")
    starts, total = [], 0
    for part, n in sorted(ordered.groupBy("part").count().collect()):  # one row for each shuffle partition
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "part int, start long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("no_source", "source")) - 1
    ranked = ordered.withColumn("rank", rank).join(F.broadcast(offsets), "part").withColumn("rank", F.col("rank") + F.col("start"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    return ranked.select("source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size, weight) with target.

    Targets share total by weight; those above max_epochs x source_size are clamped there and what they lose is shared anew by
    weight among the rest, until none is above. Each round reads one row of sums; a round clamps a source or ends. A total
    that all caps together can't hold leaves every source at its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    # A source is clamped where cap / weight is under the level that the rest share, and that only rises.
    level = 0.0
    while True:
        clamped = cap <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(clamped, cap).otherwise(0.0)).alias("used"), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        rise = max(0.0, total - (row["used"] or 0.0)) / row["open"]
        if rise <= level * (1 + 1e-12):
            break
        level = rise
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, *, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), total_share: float = 1.0, max_epochs: float = 3.0, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often each document enters a mix of sources by weight.

    docs: doc_id, text, source. Size: words of the text (null: 0). Returns doc_id, size, source, source_size, target, reps,
    taken (reps x size) and carried (a struct of the columns named in carry) per input row.
    Every document is repeated floor(target / source_size) times; one repetition more goes to the documents that come first by
    a seeded hash of doc_id and text, until the source's taken words are nearest its target, so it ends within half a document
    of it. Where that order falls is found with two histograms of the hash per source, so no task sees a whole source. Null is a
    source of its own and comes last; sources without words have target 0 and are taken 0 times. Repeated rows are
    documents of their own. An empty table gives an empty result. Same rows and seed, same result.
    """
    bins = 4096
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))).alias("u"), F.struct(F.lit(True).alias("row"), *carry).alias("carried"))
    rows = rows.withColumn("bin1", F.shiftrightunsigned("u", 52).cast("int")).withColumn("bin2", (F.shiftrightunsigned("u", 40) % bins).cast("int"))
    rows = materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(source_weights(sizes, cycle), "weights")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * total_share
    sources = materialize(water_fill(sources, float(total), max_epochs), "targets")
    has = F.col("source_size") > 0
    whole = F.when(has, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int")
    plan = sources.select(F.col("source").alias("s"), "source_size", "target", whole.alias("whole"))
    plan = plan.withColumn("rest", F.when(has, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))

    def cut(counts: DataFrame, name: str) -> DataFrame:
        """For each s, the bin in which the running size passes rest, and what is left of rest before it."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumn("before", before).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).groupBy("s").agg(F.min_by(F.struct(F.col(name).alias("at"), (F.col("rest") - F.col("before")).alias("left")), name).alias("cut"))

    same = F.col("source").eqNullSafe(F.col("s"))
    small = F.broadcast if sources.count() <= 100_000 else (lambda df: df)
    first = rows.groupBy("source", "bin1").agg(F.sum("size").alias("n")).join(small(plan), same).select("s", "bin1", "n", "rest")
    first = cut(first, "bin1").select(F.col("s").alias("s1"), F.col("cut.at").alias("cut1"), F.col("cut.left").alias("left1"))
    plan1 = materialize(plan.join(first, F.col("s").eqNullSafe(F.col("s1")), "left").drop("s1"), "cut1")
    second = rows.join(small(plan1), same & (F.col("bin1") == F.col("cut1"))).groupBy("s", "bin2", "left1").agg(F.sum("size").alias("n")).withColumnRenamed("left1", "rest")
    second = cut(second, "bin2").select(F.col("s").alias("s1"), F.col("cut.at").alias("cut2"), F.col("cut.left").alias("left2"))
    plan2 = materialize(plan1.join(second, F.col("s").eqNullSafe(F.col("s1")), "left").drop("s1"), "cut2")

    placed = rows.join(small(plan2), same)
    inside = (F.col("bin1") == F.col("cut1")) & (F.col("bin2") == F.col("cut2"))
    sure = F.col("cut1").isNotNull() & ((F.col("bin1") < F.col("cut1")) | ((F.col("bin1") == F.col("cut1")) & F.col("cut2").isNotNull() & (F.col("bin2") < F.col("cut2"))))
    placed = placed.withColumn("edge", F.coalesce(inside, F.lit(False)))
    # The few documents of the bin in which the target falls, in order of the hash; one more if that comes nearer.
    running = F.sum("size").over(Window.partitionBy("s").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.filter("edge").withColumn("more", (running - F.col("size") / 2 <= F.col("left2")).cast("int"))
    rest = placed.filter(~F.col("edge")).withColumn("more", F.coalesce(sure, F.lit(False)).cast("int"))
    reps = F.least(F.col("whole") + F.col("more"), F.floor(F.lit(float(max_epochs)) + 1e-9)).cast("int")
    return edge.unionByName(rest).select("doc_id", "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", reps.alias("reps"), (reps * F.col("size")).cast("long").alias("taken"), "carried")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "reps")


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
