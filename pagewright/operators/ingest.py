"""Sniffing of dirty tables: delimiter, encoding, header row, sheet and file kind, as projections and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delimiters in order of preference.
DELIMITERS = [",", ";", "\t", "|"]


def delimiter_scores(texts: DataFrame, key: str, text: str = "text", n_lines: int = 10) -> DataFrame:
    """key, delimiter, rank, score: mean over 1 + population variance of the counts on the first lines that aren't blank."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("pos", "line")).filter((F.col("pos") < n_lines) & (F.trim("line") != ""))
    marks = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)]))
    counted = lines.withColumn("m", marks).select(key, "m.rank", "m.delimiter", (F.length("line") - F.length(F.replace(F.col("line"), F.col("m.delimiter"), F.lit("")))).alias("n"))
    return counted.groupBy(key, "rank", "delimiter").agg((F.avg("n") / (1 + F.var_pop("n"))).alias("score"))


def header_row(rows: DataFrame, key: str, pos: str, cells: str, within: int = 5, least: int = 3) -> DataFrame:
    """key, header_row: the first of the leading rows with enough filled cells, else 0."""
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when((F.col(pos) < within) & (F.col(cells) >= least), F.col(pos))), F.lit(0)).alias("header_row"))


def unique_headers(headers: list[str]) -> list[str]:
    """Blank headers named by position; repeated ones numbered (2), (3) and so on."""
    out: list[str] = []
    for i, h in enumerate(headers):
        name = base = (h or "").strip() or f"Col{i + 1}"
        n = 1
        while name in out:
            n += 1
            name = f"{base} ({n})"
        out.append(name)
    return out


# Signatures in hexadecimal at the start of a file, in order of test.
SIGNATURES = [("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("zip", "504B0304"), ("zip", "504B0506"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("bmp", "424D"), ("ico", "00000100")]
BRANDS = {"avif": ["61766966", "61766973"], "heic": ["68656963", "68656978", "68657663", "6D696631", "6D736631"]}
KIND_OF_EXTENSION = {"xlsx": "zip", "docx": "zip", "zip": "zip", "csv": "text", "txt": "text", "tsv": "text", "json": "text", "svg": "svg", "pdf": "pdf", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "webp": "webp", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "ico": "ico", "avif": "avif", "heic": "heic", "heif": "heic"}


def magic_kind(content: Column) -> Column:
    """Kind of a file by its first 512 bytes: webp, avif, heic, then signatures, svg, text, else unknown."""
    head = F.hex(F.substring(content, 1, 512))
    brand = F.when(F.substring(head, 9, 8) == "66747970", F.substring(head, 17, 8))
    kind = F.when((F.substring(head, 1, 8) == "52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for name, brands in BRANDS.items():
        kind = kind.when(brand.isin(brands), name)
    for name, start in SIGNATURES:
        kind = kind.when(head.startswith(start), name)
    text = F.try_to_binary(head, F.lit("hex")).cast("string")
    kind = kind.when(F.lower(text).rlike(r"(?s)^\x{feff}?\s*(<\?xml.*<svg|<svg)"), "svg")
    return kind.when(looks_textual(head), "text").otherwise("unknown")


def looks_textual(head: Column) -> Column:
    """No control bytes but blanks, or a UTF-16 byte order mark; head in hexadecimal."""
    return (head != "") & (head.startswith("FFFE") | head.startswith("FEFF") | ~head.rlike("^(..)*(0[0-8EF]|1.)"))


def kind_fits(kind: Column, extension: Column) -> Column:
    """Whether a file's kind is that of its extension; an extension without rule fits all."""
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in KIND_OF_EXTENSION.items() for x in pair]), F.lower(extension))
    return F.coalesce((wanted == kind) | ((wanted == "svg") & (kind == "text")), F.lit(True))


def text_encoding(content: Column) -> Column:
    """utf-16le by its mark, utf-8 by its mark or if the first 64 KB are valid, else latin1."""
    head = F.hex(F.substring(content, 1, 3))
    valid = F.is_valid_utf8(F.substring(content, 1, 65536).cast("string"))
    return F.when(head.startswith("FFFE"), "utf-16le").when(head.startswith("EFBBBF") | valid, "utf-8").otherwise("latin1")


def decoded(content: Column) -> Column:
    """Text of a file in its own encoding, without a mark."""
    kind = text_encoding(content)
    text = F.when(kind == "utf-16le", F.decode(content, "UTF-16LE")).when(kind == "utf-8", F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"^\x{feff}", "")


def without_title_rows(text: Column, delimiter: Column, within: int = 5, least: int = 2) -> Column:
    """The text from the first of the leading lines that has enough delimiters on; unchanged if none has."""
    lines = F.split(text, r"\r?\n", -1)
    full = F.transform(F.slice(lines, 1, within), lambda x: F.length(x) - F.length(F.replace(x, delimiter, F.lit(""))) >= least)
    first = F.array_position(full, True)
    return F.when(first > 1, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise(text)


# Words in sheet names that speak for or against product rows, and their weights.
SHEET_FOR = "produit|product|catalog|article|item|tarif|liste|data"
SHEET_AGAINST = "note|readme|legend|info|config|param|image|schema|sommaire|toc"


def sheet_score(name: Column, rows: Column, hidden: Column) -> Column:
    """Rows of a sheet, and 200 more or less by its name; hidden sheets are far below."""
    low = F.lower(name)
    return rows + F.when(low.rlike(SHEET_FOR), 200).otherwise(0) - F.when(low.rlike(SHEET_AGAINST), 200).otherwise(0) - F.when(hidden, 10000).otherwise(0)
