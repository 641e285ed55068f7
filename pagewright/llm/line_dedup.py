"""Line dedup in DataFrame functions only: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id, below all others.
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; translate() only where lower() would touch more."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def dedup_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines that at least min_docs documents hold, but in the document with the largest doc_id among them.

    docs: doc_id, text; other columns are ignored, but for those named in carry, which come back in the struct carried.
    Returns doc_id, n_lines, n_dropped, text (what stays) and carried per input row.
    A line's key is line_key(); keys under min_chars code points are never dropped. A document that holds a key twice counts
    once. Null or empty text is one empty line. Rows that share doc_id count as one document; each row keeps its own lines.
    A null doc_id is one document below all others. An empty table gives an empty result. Memory is bounded by one document:
    hot lines are summed before they are shuffled, and the joins are ordinary ones, whose skewed partitions Spark can split.
    """
    lines = F.split(F.col("text"), "\n", -1)
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct(F.lit(True).alias("row"), *carry).alias("carried"))
    rows = rows.withColumn("tid", F.xxhash64("text"))
    long_lines = (
        rows.select("did", "tid", F.posexplode(lines).alias("pos", "line"))
        .select("did", "tid", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("did", "tid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    )
    shared = long_lines.groupBy("h1", "h2").agg(F.count_distinct("did").alias("n_docs"), F.max("did").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    # As a table it comes to the join through an exchange of its own, without which Spark can't split a hot line's partition.
    shared = materialize(shared.select("h1", "h2", "keeper"), "shared_lines")
    dropped = (
        long_lines.join(shared, ["h1", "h2"])
        .filter(F.col("did") != F.col("keeper"))
        .groupBy("did", "tid")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    joined = rows.join(dropped, ["did", "tid"], "left").select("doc_id", "text", "carried", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    n_gone, n_lines = F.size("gone"), F.size(lines)
    # One flag per line, built from the gaps between the dropped positions in time linear in the lines.
    flags = F.flatten(
        F.transform(
            "gone",
            lambda p, i: F.concat(
                F.array_repeat(F.lit(True), (p - F.when(i == 0, F.lit(-1)).otherwise(F.element_at("gone", F.greatest(i, F.lit(1)))) - 1).cast("int")),
                F.array(F.lit(False)),
            ),
        )
    )
    kept = F.filter(F.arrays_zip(lines.alias("line"), flags.alias("stays")), lambda z: F.coalesce(z["stays"], F.lit(True)))
    kept = F.array_join(F.transform(kept, lambda z: z["line"]), "\n")
    return joined.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        n_gone.cast("long").alias("n_dropped"),
        F.when(n_gone == 0, F.col("text")).otherwise(kept).alias("text"),
        "carried",
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, l.pos AS pos, l.line AS line,
         translate(trim(l.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) AS l FROM documents)
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": OP2_SQL}
