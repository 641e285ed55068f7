"""WARC archives: written once per distinct payload with an index, and read back by coalesced byte ranges of the index."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, scratch_path

#: Bytes after which a task goes on in a new archive, gaps that a read bridges, and bytes that one read takes at most
#: (a longer record is a read of its own).
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
#: Bytes of records that a reading task has, about.
TASK_BYTES = 32 << 20

INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id long"


def file_system(uri: str):
    """File system and path of a folder that all executors share: file://, hdfs://, s3:// and the like."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(page_id, url, kind: str, digest: str, payload: bytes, size: int, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the HTTP headers of its full payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = lambda x: f"<urn:x-page:{'null' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


# Characters that stay as they are in a target URI (fixed values of RFC 3986, and % itself).
SAFE = "%:/?#[]@!$&'()*+,;=-._~"


def parse(member: bytes) -> dict:
    """Headers and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    own = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(own["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    number = lambda s: None if s is None or s[12:-1] == "null" else int(s[12:-1])
    return {
        "page_id": number(own["WARC-Record-ID"]),
        "url": own.get("WARC-Target-URI"),
        "record_type": own["WARC-Type"],
        "payload_digest": base64.b32decode(own["WARC-Payload-Digest"][5:]).hex(),
        "payload_bytes": int(fields["Content-Length"]),
        "refers_to": number(own.get("WARC-Refers-To")),
        "payload": payload,
    }


def write_archives(pages: DataFrame, folder: str, *, min_revisit: int = 1000) -> DataFrame:
    """Write a record per page to archives in folder, and return their index (INDEX), itself a table in the shared folder.

    pages: page_id, url, html; other columns are ignored. Payload: html in UTF-8; null is empty. Of records with equal payloads of at
    least min_revisit bytes that with the largest page_id (null is below all) is the response and the others are revisits without
    the payload; rows that repeat that page_id with that payload are responses too. Smaller records are all responses. A null
    url has no target URI. Blanks and control characters of a URL are percent-encoded. Equal payloads are summed before
    the shuffle, and the skewed partitions of a hot payload can be split. A task that runs again writes archives of other names;
    the index has only those of the attempt that ended. An empty table gives an empty index.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    copies = rows.filter(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).filter("n > 1")
    rows = rows.join(copies.select("digest", "first", F.lit(True).alias("copied")), "digest", "left")
    revisit = F.col("copied") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("revisit", F.coalesce(revisit, F.lit(False))).select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), F.octet_length("html").alias("size"), "digest", "revisit", "first")

    def run(batches):
        fs, path = file_system(folder)
        fs.create_dir(path)
        out, name, offset = None, None, 0
        try:
            for batch in batches:
                index = []
                html = batch.column(2).cast(pa.large_binary() if pa.types.is_large_string(batch.column(2).type) else pa.binary())
                for page_id, url, payload, size, digest, again, first in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), html, *batch.columns[3:])), strict=True):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    kind = "revisit" if again else "response"
                    data = record(page_id, url, kind, digest, payload or b"", size, first if again else None)
                    out.write(data)
                    index.append((name, offset, len(data), url, digest, kind, page_id))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*index, strict=True), ARROW_INDEX, strict=True)] if index else [pa.array([], t) for t in ARROW_INDEX], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, INDEX), "index")


ARROW_INDEX = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges as reads (start, end, ranges): neighbours join while gaps and reads stay small."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in ranges:
        if out and offset - out[-1][1] <= GAP_BYTES and offset + length - out[-1][0] <= READ_BYTES:
            out[-1][2].append((offset, length))
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), out[-1][2])
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read_records(selected: DataFrame, folder: str, *, partitions: int | None = None) -> DataFrame:
    """Records of selected index rows (archive, offset, length): page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    Rows are dealt by archive and block of READ_BYTES to as many tasks as have TASK_BYTES of records each, and sorted by offset; each task
    then joins neighbouring ranges into reads of READ_BYTES at most. A row given twice is returned once. The digest of a
    response is checked against its payload.
    """
    rows = selected.select("archive", F.floor(F.col("offset") / READ_BYTES).alias("block"), "offset", "length").distinct()
    if partitions is None:
        partitions = (rows.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES + 1
    rows = rows.repartition(partitions, "archive", "block")
    rows = rows.sortWithinPartitions("archive", "offset")
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        fs, path = file_system(folder)
        for batch in batches:
            archives: dict[str, list[tuple[int, int]]] = {}
            for archive, offset, length in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                archives.setdefault(archive, []).append((offset, length))
            for archive, ranges in archives.items():
                with fs.open_input_file(f"{path}/{archive}") as source:
                    for start, end, own in spans(ranges):
                        data = source.read_at(end - start, start)
                        got = [parse(data[o - start : o - start + n]) for o, n in own]
                        for r in got:
                            if r["record_type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() != r["payload_digest"]:
                                raise ValueError(f"{archive}: a payload doesn't have its digest")
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in zip(names, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1
)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.first IS NOT NULL AND g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": OP8_SQL}
