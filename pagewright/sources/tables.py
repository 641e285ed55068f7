"""Product tables from files: delimited text with sniffed encoding, delimiter and header; sheets of workbooks; listings of archives."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pagewright.operators.ingest import decoded, delimiter_scores, kind_fits, magic_kind, text_encoding, unique_headers, without_title_rows
from pagewright.operators.ranking import best

#: Limits of a file, in bytes and rows, and of an archive: entries, inflated bytes, inflation ratio.
MAX_BYTES, MAX_ROWS = 100 << 20, 200_000
MAX_ENTRIES, MAX_INFLATED, MAX_RATIO = 5000, 2 << 30, 100


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, extension, length, kind (by content), fits (kind and extension agree), content for every file under path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    rows = raw.withColumn("extension", extension).withColumn("kind", magic_kind(F.col("content")))
    return rows.select("path", "extension", "length", "kind", kind_fits(F.col("kind"), F.col("extension")).alias("fits"), "content")


def sniffed(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """path, encoding, delimiter, text (decoded, from the header row on) for delimited files; one over MAX_BYTES is an error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    refused = F.raise_error(F.concat("path", F.lit(f" has more than {MAX_BYTES} bytes"))).cast("binary")
    raw = raw.withColumn("content", F.when(F.col("length") <= MAX_BYTES, F.col("content")).otherwise(refused))
    texts = raw.select("path", text_encoding(F.col("content")).alias("encoding"), decoded(F.col("content")).alias("text"))
    top = best(delimiter_scores(texts, "path"), ["path"], [F.desc("score"), F.asc("rank")]).select("path", F.when(F.col("score") > 0, F.col("delimiter")).otherwise(",").alias("delimiter"))
    rows = texts.join(top, "path", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(",")))
    return rows.withColumn("text", without_title_rows(F.col("text"), F.col("delimiter")))


def read_delimited(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Cells of delimited files in long form: path, row_idx (from 0), col_idx, header, value. Quoted cells may hold delimiters, quotes and
    line breaks. Blank rows go; short rows give nulls; repeated headers are numbered. MAX_ROWS rows or more are an error. A file is
    read by one task."""
    parsed = sniffed(spark, path, glob).select("path", "delimiter", "text").mapInPandas(_records, "path string, row_idx int, headers array<string>, cells array<string>")
    long = parsed.select("path", "row_idx", F.posexplode("headers").alias("col_idx", "header"), "cells")
    return long.select("path", "row_idx", "col_idx", "header", F.get("cells", F.col("col_idx")).alias("value"))


def _records(files):
    import pandas as pd

    columns = ["path", "row_idx", "headers", "cells"]
    for batch in files:
        for path, delimiter, text in batch.itertuples(index=False):
            rows = ([c.strip() for c in r] for r in csv.reader(io.StringIO(text or "", newline=""), delimiter=delimiter))
            rows = (r for r in rows if any(r))
            headers, held = unique_headers(next(rows, [])), []
            for i, cells in enumerate(rows):
                if i + 1 >= MAX_ROWS:
                    raise ValueError(f"{path} has {MAX_ROWS} rows or more")
                held.append((path, i, headers, cells))
                if len(held) == 10_000:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
            yield pd.DataFrame(held, columns=columns)


# ---------------------------------------------------------------- workbooks

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
# Error cells, read as empty, and number formats that are dates.
ERRORS = {"#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!"}
DATE_FORMATS = {14, 15, 16, 17, 22}


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes) -> Iterator[tuple[int, str, bool, int, list[str]]]:
    """(place of the sheet, sheet, hidden, row number, cells) of a workbook: dates as days, formulas by their value, errors and blanks as ''."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS)]
        dated = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iterfind(".//m:numFmt", NS) if re.search("[ymd]{2}", f.get("formatCode", ""))} | DATE_FORMATS
            dated = {i for i, x in enumerate(styles.iterfind("m:cellXfs/m:xf", NS)) if int(x.get("numFmtId", 0)) in own}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for place, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", NS)):
            target = targets[sheet.get(f"{{{NS['r']}}}id")].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for number, row in enumerate(tree.iterfind(".//m:row", NS)):
                cells: list[str] = []
                for c in row.findall("m:c", NS):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells) + 1)
                    cells[at] = cell_text(c, shared, dated)
                if any(x.strip() for x in cells):
                    yield place, sheet.get("name"), sheet.get("state", "visible") != "visible", number, cells


def cell_text(cell, shared: list[str], dated: set[int]) -> str:
    kind, value = cell.get("t", "n"), cell.find("m:v", NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{{{NS['m']}}}t"))
    raw = "" if value is None else value.text or ""
    if kind == "s":
        return shared[int(raw)] if raw else ""
    if kind == "e" or raw in ERRORS:
        return ""
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "n" and raw and int(cell.get("s", 0)) in dated:
        return (date(1899, 12, 30) + timedelta(days=int(float(raw)))).isoformat()
    return re.sub(r"\.0$", "", raw)


class WorkbookSource(DataSource):
    """spark.read.format("workbook").load(path): path, sheet_no, sheet, hidden, row_idx, cells for each row that isn't blank. One task a file."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, sheet_no int, sheet string, hidden boolean, row_idx int, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options.get("path", ""))


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.path)
        from pyarrow import fs as pafs

        info = fs.get_file_info(root)
        found = [root] if info.type == pafs.FileType.File else [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.path.endswith(".xlsx")]
        return [InputPartition(p) for p in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.value) as f:
            data = f.read()
        for row in workbook_rows(data):
            yield partition.value, *row


def opened(uri: str):
    """File system and path of a URI or local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(path)


def product_sheet(rows: DataFrame) -> DataFrame:
    """Cells of the best sheet of each workbook in long form (path, sheet, row_idx, col_idx, header, value): the sheet with most rows, by its
    name, the first on ties; the header is the first of five rows with three filled cells, and repeated headers are numbered."""
    from pyspark.sql import Window

    from pagewright.operators.ingest import sheet_score

    order = Window.partitionBy("path", "sheet").orderBy("row_idx")
    rows = rows.withColumn("n", F.row_number().over(order) - 1)
    sheets = rows.groupBy("path", "sheet_no", "sheet", "hidden").agg(F.count(F.lit(1)).alias("rows"), F.min(F.when((F.col("n") < 5) & (F.size(F.filter("cells", lambda c: F.trim(c) != "")) >= 3), F.col("n"))).alias("head"))
    top = best(sheets.withColumn("score", sheet_score(F.col("sheet"), F.col("rows"), F.col("hidden"))), ["path"], [F.desc("score"), F.asc("sheet_no")]).select("path", "sheet", F.coalesce("head", F.lit(0)).alias("head"))
    own = rows.join(top, ["path", "sheet"])
    heads = own.filter("n = head").select("path", "sheet", F.col("cells").alias("headers"))
    named = F.udf(unique_headers, "array<string>")("headers")  # one row a workbook
    heads = heads.withColumn("headers", named)
    body = own.filter("n > head").join(heads, ["path", "sheet"])
    long = body.select("path", "sheet", (F.col("n") - F.col("head") - 1).alias("row_idx"), F.posexplode("headers").alias("col_idx", "header"), "cells")
    return long.select("path", "sheet", "row_idx", "col_idx", "header", F.get("cells", F.col("col_idx")).alias("value"))


# ---------------------------------------------------------------- archives


class ListArchive:
    """Table function over an archive's bytes: name, size, compressed size and extension of its files, and why it is refused, if it is."""

    def eval(self, content: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                entries = [e for e in z.infolist() if not e.is_dir()]
        except zipfile.BadZipFile:
            yield None, None, None, None, "not an archive"
            return
        size = sum(e.file_size for e in entries)
        if len(entries) > MAX_ENTRIES or size > MAX_INFLATED or size > MAX_RATIO * max(1, sum(e.compress_size for e in entries)):
            yield None, None, None, None, "too large"
            return
        for e in entries:
            if ".." in e.filename.replace("\\", "/").split("/") or e.filename.startswith("/"):
                yield e.filename, None, None, None, "unsafe path"
            else:
                yield e.filename, e.file_size, e.compress_size, e.filename.rpartition(".")[2].lower(), None


ENTRY = "name string, size long, compressed long, extension string, refused string"


def list_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """path and ListArchive's columns for every archive under path."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("list_archive", udtf(ListArchive, returnType=ENTRY))
    spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).createOrReplaceTempView("pagewright_archives")
    return spark.sql("SELECT a.path, e.* FROM pagewright_archives a, LATERAL list_archive(a.content) e")


def asset_index(names: DataFrame) -> DataFrame:
    """Assets by name (path, name): base name in lower case, kind (image or schema), a suffix _1, _2 for repeats, and a second row without accents."""
    from pyspark.sql import Window

    from pagewright.functions.text import strip_accents, url_basename

    # Extensions of images; schemas are PDF files.
    images = "png jpg jpeg gif webp tiff tif bmp jfif ico heic heif avif".split()
    base = url_basename(F.col("name"))
    extension = F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))
    rows = names.select("path", base.alias("base"), F.lower(F.regexp_replace(base, r"\.[^.]+$", "")).alias("stem"), F.when(extension.isin(images), "image").when(extension == "pdf", "schema").alias("kind")).filter("kind IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("stem", "kind").orderBy("path")) - 1
    rows = rows.withColumn("n", n).withColumn("stem", F.when(F.col("n") > 0, F.concat_ws("_", "stem", F.col("n").cast("string"))).otherwise(F.col("stem"))).drop("n")
    bare = rows.withColumn("plain", strip_accents(F.col("stem"))).filter("plain <> stem").select("path", "base", F.col("plain").alias("stem"), "kind")
    return rows.unionByName(bare.join(rows.select("stem", "kind"), ["stem", "kind"], "left_anti"))

