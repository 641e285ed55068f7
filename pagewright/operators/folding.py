"""Folds over ordered groups in one pass over sorted partitions, without a pandas frame for each group."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_groups(df: DataFrame, keys: list[str], order: list[str], schema: str, fold: Callable[[list[dict]], Iterable[dict]]) -> DataFrame:
    """Rows that fold() gives for each group's rows in order; a group is in memory as a whole, a partition isn't."""
    spark = df.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        out: list[dict] = []
        for _, group in itertools.groupby(rows, key=lambda r: [r[k] for k in keys]):
            out += fold(list(group))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
