"""Shared pieces of the training-data operators: scratch tables in the shared folder, word bytes, packed key blocks."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Text bytes that one chunk of documents holds at most (a longer document is a chunk of its own).
CHUNK_BYTES = 24 << 20


#: Bytes of a batch of rows that goes to a Python worker. Rows are whole texts here, so a count of rows bounds nothing.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Batches for Python workers bounded by bytes, where the session doesn't say otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where that is unset, a temporary one in one process, and an error on a cluster."""
    bounded(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pagewright/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column_or_null(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def n_partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


# ---------------------------------------------------------------- packed documents and packed sorted keys


def compress(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def decompress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)


def pack_docs(ids: list[int | None], texts: list[bytes]) -> bytes:
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_docs(data: bytes) -> tuple[list[int | None], list[bytes]]:
    table = pa.ipc.open_stream(data).read_all()
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences, one byte plane after another, compressed."""
    keys = np.ascontiguousarray(keys, np.uint64)
    step = np.empty_like(keys)
    if len(keys):
        step[0] = keys[0]
        np.subtract(keys[1:], keys[:-1], out=step[1:])
    return compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_counts(codes: np.ndarray, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes, and how often each occurs among the counted positions (all, if None).

    Codes go through a few hash tables in turn; what loses its slot in one goes on to the next. Faster than sorting all codes.
    """
    keys, counts, seed = [], [], 0
    while len(codes):
        if len(codes) < 4096:
            own, back = np.unique(codes, return_inverse=True)
            keys.append(own)
            counts.append(np.bincount(back if counted is None else back[counted], minlength=len(own)))
            break
        bits = min(21, max(8, int(len(codes)).bit_length() - 1))
        slot = (mix64(codes + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)).astype(np.int64)
        table = np.zeros(1 << bits, np.uint64)
        table[slot] = codes
        hit = table[slot] == codes
        used = np.zeros(1 << bits, bool)
        used[slot] = True
        keys.append(table[used])
        counts.append(np.bincount(slot[hit if counted is None else hit & counted], minlength=1 << bits)[used])
        if counted is not None:
            counted = counted[~hit]
        codes = codes[~hit]
        seed += 1
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    return keys[order], counts[order]


class KeyIndex:
    """Position of each code in a sorted array of distinct keys that holds them all."""

    def __init__(self, keys: np.ndarray):
        self.levels, rest, at, seed = [], keys, np.arange(len(keys), dtype=np.int64), 0
        while len(rest):
            bits = max(8, min(23, int(len(rest)).bit_length() + 1))
            shift = np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            slot = (mix64(rest + shift) >> np.uint64(64 - bits)).astype(np.int64)
            place = np.full(1 << bits, -1, np.int32)
            place[slot] = at
            held = place[slot] == at
            self.levels.append((shift, bits, place))
            rest, at, seed = rest[~held], at[~held], seed + 1
        self.keys = keys

    def find(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.int32)
        where = None
        for shift, bits, place in self.levels:
            slot = (mix64(codes + shift) >> np.uint64(64 - bits)).astype(np.int64)
            got = place[slot]
            hit = (got >= 0) & (self.keys[got] == codes)
            if where is None:
                out[:] = got
                where = np.flatnonzero(~hit)
            else:
                out[where] = got
                where = where[~hit]
            codes = codes[~hit]
            if not len(codes):
                break
        return out


def chunked(batches, size: int = CHUNK_BYTES):
    """Lists of (doc_id, text bytes) from record batches of doc_id and text, each of about size bytes."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            if held and held + len(text) > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            held += len(text) + 16
    if ids:
        yield ids, texts


def by_group(batches, *names: str):
    """Rows of record batches that come sorted by the named columns, as (group key, iterator of row dicts)."""
    import itertools

    def rows():
        for batch in batches:
            for i in range(len(batch)):  # one at a time, as payloads can be large
                yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}

    for key, group in itertools.groupby(rows(), key=lambda r: tuple(r[n] for n in names)):
        yield key, group


def grouped(batches, names: list[str]):
    """Groups of record batches that come sorted by the named long or int columns, as (key, table)."""
    key, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(c).to_numpy() for c in names]
        edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
            now = tuple(int(c[start]) for c in columns)
            if held and now != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = now
            held.append(batch.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()
