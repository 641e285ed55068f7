import json
import zipfile

from pyspark.sql import functions as F

from pagewright.sources import documents, tables


def test_kinds_and_encodings(spark, tmp_path):
    samples = {"a.png": b"\x89PNG\r\n\x1a\n..", "b.jpg": b"\xff\xd8\xff\xe0", "c.csv": b"a;b;c\n1;2;3\n", "d.webp": b"RIFF\0\0\0\0WEBPVP8 ", "e.avif": b"\0\0\0\x18ftypavif", "f.pdf": b"%PDF-1.7", "g.svg": b"<svg xmlns=''>", "h.bin": b"\x01\x02\x03", "i.png": b"plain text"}
    for name, data in samples.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["fits"]) for r in tables.files(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", True), "b.jpg": ("jpeg", True), "c.csv": ("text", True), "d.webp": ("webp", True), "e.avif": ("avif", True), "f.pdf": ("pdf", True), "g.svg": ("svg", True), "h.bin": ("unknown", True), "i.png": ("text", False)}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "semi.csv").write_bytes("Titre du catalogue\nNom;Prix;Note\nÉvier;12,5;\"a;b\"\"c\"\n\nBac;7\n".encode())
    (tmp_path / "latin.csv").write_bytes("Nom|Prix|Réf\nÉvier|12|x\n".encode("cp1252"))
    (tmp_path / "wide.csv").write_bytes(b"\xff\xfe" + "a\tb\tc\n1\t2\t3\n".encode("utf-16le"))
    (tmp_path / "empty.csv").write_bytes(b"")  # gives no rows
    meta = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["delimiter"]) for r in tables.sniffed(spark, str(tmp_path)).collect()}
    assert meta == {"semi.csv": ("utf-8", ";"), "latin.csv": ("latin1", "|"), "wide.csv": ("utf-16le", "\t")}
    rows = tables.read_delimited(spark, str(tmp_path)).orderBy("path", "row_idx", "col_idx").collect()
    cells = [(r["path"].rsplit("/", 1)[1], r["row_idx"], r["header"], r["value"]) for r in rows]
    assert ("semi.csv", 0, "Note", 'a;b"c') in cells and ("semi.csv", 1, "Note", None) in cells
    assert ("latin.csv", 0, "Nom", "Évier") in cells and ("wide.csv", 0, "c", "3") in cells


def workbook(path, sheets):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"{" state=" + chr(34) + "hidden" + chr(34) if hidden else ""}/>' for i, (n, hidden, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<x Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</R>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Nom</t></si><si><r><t>Év</t></r><r><t>ier</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, (_, _, body) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    body = '<row r="1"><c r="A1" t="inlineStr"><is><t>Titre</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>Date</t></is></c><c r="D2" t="inlineStr"><is><t>Prix</t></is></c></row>'
    body += '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45000</v></c><c r="C3" t="b"><v>1</v></c><c r="D3"><v>12.0</v></c></row><row r="4"/><row r="5"><c r="A5" t="e"><v>#N/A</v></c><c r="D5"><v>7.5</v></c></row>'
    workbook(tmp_path / "p.xlsx", [("Notes", False, body + body.replace('r="', 'r="')), ("Produits", False, body), ("Secret", True, body * 3)])
    cells = tables.product_sheet(tables.read_workbook(spark, str(tmp_path))).orderBy("row_idx", "col_idx").collect()
    assert {r["sheet"] for r in cells} == {"Produits"}
    assert [(r["header"], r["value"]) for r in cells][:4] == [("Nom", "Évier"), ("Date", "2023-03-15"), ("Col3", "true"), ("Prix", "12")]
    assert [(r["header"], r["value"]) for r in cells][4:] == [("Nom", ""), ("Date", ""), ("Col3", ""), ("Prix", "7.5")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("a/évier.JPG", b"x")
        z.writestr("../evil.png", b"x")
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros", b"\0" * 5_000_000)
    (tmp_path / "bad.zip").write_bytes(b"nope")
    got = {(r["path"].rsplit("/", 1)[1], r["name"], r["refused"]) for r in tables.list_archives(spark, str(tmp_path)).collect()}
    assert got == {("ok.zip", "a/évier.JPG", None), ("ok.zip", "../evil.png", "unsafe path"), ("bomb.zip", None, "too large"), ("bad.zip", None, "not an archive")}


def test_asset_index(spark):
    names = spark.createDataFrame([("1", "x/Mégère.jpg"), ("2", "y/mégère.JPG"), ("3", "plan.pdf"), ("4", "note.txt")], "path string, name string")
    got = {(r["stem"], r["kind"]) for r in tables.asset_index(names).collect()}
    assert got == {("mégère", "image"), ("mégère_1", "image"), ("megere", "image"), ("megere_1", "image"), ("plan", "schema")}


def test_pages_and_runs(spark, tmp_path):
    page = {"page_number": 0, "page_size": {"width": 842, "height": 595}, "slots": [{"type": "blob", "id": "", "bbox": [5, 0, 1]}], "raw_spans": [{"text": "Évier", "bbox": [1, 2, 3, 4], "font": "F", "size": 9, "color": "#000000"}, {"text": "  ", "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "page-001.json").write_text(json.dumps(page))
    (tmp_path / "page-002.json").write_text("{broken")
    pages = documents.read_pages(spark, str(tmp_path)).cache()
    assert {r["file"]: r["refused"] is None for r in pages.collect()} == {"page-001.json": True, "page-002.json": False}
    spans = documents.page_spans(pages).collect()
    assert [(s["text"], s["bbox"]["y1"]) for s in spans] == [("Évier", 4.0)]
    errors = documents.page_slots(pages).select(F.explode("errors").alias("e")).select("e.path").collect()
    assert {e["path"] for e in errors} == {"id", "type", "bbox"}
    (tmp_path / "a.meta.json").write_text(json.dumps({"productCount": 3, "stats": {"extractMs": 5, "renderMs": 7}, "uploadedFiles": ["x"]}))
    runs = documents.read_runs(spark, str(tmp_path))
    assert [(r["products"], r["duration"]) for r in runs.collect()] == [(3, 12.0)]
    managed = spark.createDataFrame([("x",), ("y",)], "name string")
    assert [r["name"] for r in documents.orphan_files(managed, runs).collect()] == ["y"]


def test_quoted_line_breaks_and_repeated_headers(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes('Nom;Note;Nom;;Nom\nÉvier;"a\nb;c";x;1;y\n\n"Bac ""2""";;;;\n'.encode())
    rows = tables.read_delimited(spark, str(tmp_path)).orderBy("row_idx", "col_idx").collect()
    assert [(r["row_idx"], r["header"], r["value"]) for r in rows][:5] == [(0, "Nom", "Évier"), (0, "Note", "a\nb;c"), (0, "Nom (2)", "x"), (0, "Col4", "1"), (0, "Nom (3)", "y")]
    assert rows[5]["value"] == 'Bac "2"' and len(rows) == 10


def test_files_beyond_the_limits_are_errors(spark, tmp_path, monkeypatch):
    import pytest

    (tmp_path / "big.csv").write_bytes(b"a;b\n" + b"1;2\n" * 50)
    for name, value, match in (("MAX_ROWS", 50, "rows or more"), ("MAX_BYTES", 60, "more than 60 bytes")):
        with monkeypatch.context() as m:
            m.setattr(tables, name, value)
            if name == "MAX_BYTES":
                with pytest.raises(Exception, match=match):
                    tables.read_delimited(spark, str(tmp_path)).count()
            else:
                import pandas as pd

                with pytest.raises(ValueError, match=match):
                    list(tables._records([pd.DataFrame([("p", ";", "a;b\n" + "1;2\n" * 50)])]))


def test_equal_sheets_go_by_their_place(spark, tmp_path):
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{c}{i}" t="inlineStr"><is><t>x</t></is></c>' for c in "ABC") + "</row>" for i in (1, 2, 3))
    workbook(tmp_path / "t.xlsx", [("Zebra", False, body), ("Alpha", False, body)])
    rows = tables.product_sheet(tables.read_workbook(spark, str(tmp_path))).collect()
    assert {r["sheet"] for r in rows} == {"Zebra"} and {r["header"] for r in rows} == {"x", "x (2)", "x (3)"}
