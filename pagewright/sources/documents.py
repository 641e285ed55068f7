"""JSON documents: extracted pages, run records, plans; reading with validation, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.validation import page_errors

PAGE = """page_number int, page_size struct<width: double, height: double>,
slots array<struct<type: string, id: string, bbox: array<double>, label: struct<text: string, bbox: array<double>, font: string, size: double, color: string>, kind: string, current_number: int>>,
raw_spans array<struct<text: string, bbox: array<double>, font: string, size: double, color: string>>, raw_images array<array<double>>,
raw_paths array<struct<bbox: array<double>, fill_color: string>>, extractor_version string, _corrupt_record string"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Extracted pages, in file order within their folder (page_ord), with the reason where a page can't be used (refused). A folder is a
    catalogue, so numbering is a task for each of them."""
    from pyspark.sql import Window

    rows = spark.read.schema(PAGE).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "page-*.json").json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/", 1).alias("folder"))
    refused = F.when(F.col("_corrupt_record").isNotNull(), "not JSON").when(F.col("page_number").isNull(), "no page number").when(F.coalesce(F.col("page_size.width") <= 0, F.lit(True)), "no page size")
    return rows.withColumn("refused", refused).withColumn("page_ord", F.row_number().over(Window.partitionBy("folder").orderBy("file"))).drop("_corrupt_record")


def box(b):
    return F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def page_spans(pages: DataFrame) -> DataFrame:
    """A row for each text span: page_number, span_ord, text, bbox, font, size, color; blank ones go."""
    rows = pages.filter("refused IS NULL").select("page_number", F.posexplode("raw_spans").alias("span_ord", "s"))
    return rows.filter(F.trim("s.text") != "").select("page_number", "span_ord", "s.text", box(F.col("s.bbox")).alias("bbox"), "s.font", "s.size", "s.color")


def page_slots(pages: DataFrame) -> DataFrame:
    """A row for each slot with its errors."""
    rows = pages.filter("refused IS NULL").select("page_number", F.posexplode("slots").alias("slot_ord", "s"))
    rows = rows.select("page_number", "slot_ord", "s.id", "s.type", box(F.col("s.bbox")).alias("bbox"), F.coalesce("s.label.color", F.lit("#000000")).alias("color"), F.coalesce("s.label.size", F.lit(1.0)).alias("size"), "s.label.text")
    return rows.withColumn("errors", page_errors())


def read_runs(spark: SparkSession, path: str, newest: int = 30) -> DataFrame:
    """Run records, the newest by time of the file: products, duration (the total, or the sum of the phases)."""
    phases = "extractMs classifyMs allocateMs claudeAuditMs substituteMs renderMs visualAuditMs specNormalizerMs valueFormatterMs".split()
    schema = f"productCount int, totalDurationMs double, stats struct<{', '.join(f'{p}: double' for p in phases)}>, uploadedFiles array<string>, createdAt string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.meta.json").json(path)
    rows = rows.select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_name").alias("file")).orderBy(F.desc("modified"), "file").limit(newest)
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    summed = sum((F.coalesce(finite(F.col(f"stats.{p}")), F.lit(0.0)) for p in phases[1:]), F.coalesce(finite(F.col(f"stats.{phases[0]}")), F.lit(0.0)))
    total = finite(F.col("totalDurationMs"))
    return rows.select("file", "modified", F.col("productCount").alias("products"), F.when(total > 0, total).otherwise(summed).alias("duration"), "uploadedFiles")


def orphan_files(managed: DataFrame, runs: DataFrame) -> DataFrame:
    """Managed files (name) that no run refers to."""
    return managed.join(runs.select(F.explode("uploadedFiles").alias("name")), "name", "left_anti")


def write_json_documents(df: DataFrame, column: str, path: str) -> None:
    """One document a line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
