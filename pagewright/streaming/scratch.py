"""Folders of streams: the cluster's shared folder; a temporary one only in one process, where none is set."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: streams need a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}/{name}"


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all that a stream has now into a table, and return that table."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", scratch(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table of the driver as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)
