"""Workbooks (xlsx, xlsm) as rows of text, and rows as workbooks.

A workbook is a zip of XML that one task reads row by row; a folder of workbooks is read side by side through Spark's
binaryFile source. What is wrong with a file is a row too, so one bad upload doesn't stop the others."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import text_type
from .sheets import MOST_COLUMNS, SheetError, scan_csv

MOST_BYTES, MOST_RATIO, MOST_ROWS, BATCH = 400 << 20, 200, 1_000_000, 5000
SCHEMA = "file string, row_index long, cells array<string>, code string, message string"
#: Fixed values of the format: numbers of built-in date formats.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def _named(node, name: str):
    return [x for x in node.iter() if _tag(x) == name]


def _letters(ref: str) -> int:
    """The column of a cell's name, from 0."""
    n = 0
    for c in re.match("[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _date(serial: float, old: bool) -> str:
    """The text of a date: days since the end of 1899 (or the start of 1904); a day's part alone is a time."""
    if 0 <= serial < 1 and not old:
        return (datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=round(serial * 86400))).time().isoformat()
    start = datetime.datetime(1904, 1, 1) if old else datetime.datetime(1899, 12, 31 if serial < 60 else 30)
    return (start + datetime.timedelta(seconds=round(serial * 86400))).isoformat(sep=" ")


def _text(cell, shared: list[str], dated: list[bool], old: bool) -> str:
    kind, value = cell.get("t", "n"), next((x.text or "" for x in cell if _tag(x) == "v"), "")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in _named(cell, "t"))
    if kind == "s":
        return shared[int(value)] if value else ""
    if kind == "b" and value:
        return "True" if value == "1" else "False"
    if kind == "n" and value:
        number = float(value)
        if dated[int(cell.get("s", 0))] if int(cell.get("s", 0)) < len(dated) else False:
            return _date(number, old)
        return str(int(number)) if number.is_integer() else str(number)
    return value.replace("T", " ") if kind == "d" else value


def _guard(book: zipfile.ZipFile) -> None:
    full, packed = (sum(getattr(i, k) for i in book.infolist()) for k in ("file_size", "compress_size"))
    if full > MOST_BYTES or (packed and full / packed > MOST_RATIO):
        raise SheetError("too_large", "The file expands to an implausible size.")


def _active(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The name of the active sheet's part, and whether days count from 1904."""
    root = ET.fromstring(book.read("xl/workbook.xml"))
    sheets, views, props = _named(root, "sheet"), _named(root, "workbookView"), _named(root, "workbookPr")
    if not sheets:
        raise SheetError("no_data", "The workbook has no sheets.")
    at = min(int(views[0].get("activeTab", 0)) if views else 0, len(sheets) - 1)
    link = next(v for k, v in sheets[at].attrib.items() if k.endswith("}id"))
    links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    part = next(x.get("Target") for x in links if x.get("Id") == link)
    return part.lstrip("/") if part.startswith("/") else f"xl/{part}", bool(props) and props[0].get("date1904") in ("1", "true")


def _dated(book: zipfile.ZipFile) -> list[bool]:
    """Whether each cell style shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())
    own = {int(x.get("numFmtId")): bool(re.search("[ymdhs]", plain(x.get("formatCode", "")))) for x in _named(root, "numFmt")}
    styles = [x for group in _named(root, "cellXfs") for x in group]
    return [own.get(n, n in DATES) for n in (int(x.get("numFmtId", 0)) for x in styles)]


def _grid(book: zipfile.ZipFile, part: str, old: bool) -> Iterator[tuple[int, list[str]]]:
    """(row number, cells) of each row with a cell that isn't empty."""
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, node in ET.iterparse(book.open("xl/sharedStrings.xml")):
            if _tag(node) == "si":
                shared.append("".join(x.text or "" for r in node if _tag(r) in ("t", "r") for x in ([r] if _tag(r) == "t" else _named(r, "t"))))
                node.clear()
    dated, n = _dated(book), 0
    for _, node in ET.iterparse(book.open(part)):
        if _tag(node) != "row":
            continue
        n, cells = int(node.get("r", n + 1)), {}
        for i, cell in enumerate(x for x in node if _tag(x) == "c"):
            cells[_letters(cell.get("r")) if cell.get("r") else i] = _text(cell, shared, dated, old)
        node.clear()
        if any(cells.values()):
            yield n, [cells.get(i, "") for i in range(max(cells) + 1)]


def _merged(book: zipfile.ZipFile, part: str, row: int) -> list[str]:
    """Merged ranges that touch a row."""
    found = []
    for _, node in ET.iterparse(book.open(part)):
        if _tag(node) == "mergeCell":
            ends = [int(re.sub("[^0-9]", "", x)) for x in node.get("ref").split(":")]
            if ends[0] <= row <= ends[-1]:
                found.append(node.get("ref"))
        elif _tag(node) == "row":
            node.clear()
    return found


def _sheet(content: bytes, strict: bool) -> Iterator[tuple[int, list[str]]]:
    """The header as row -1, then the rows from 0, as wide as the header."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        _guard(book)
        part, old = _active(book)
        header, at = [], -1
        for n, cells in _grid(book, part, old):
            if at < 0:
                header = [c.strip() for c in cells]
                while header and not header[-1]:
                    header.pop()
                if not header:
                    raise SheetError("no_data", "No column headers were found.")
                if strict and (merged := _merged(book, part, n)):
                    raise SheetError("merged_header", f"The header row has merged cells: {', '.join(merged)}.")
                if strict and "" in header:
                    raise SheetError("empty_header", f"Columns without a header: {', '.join(str(i + 1) for i, h in enumerate(header) if not h)}.")
                if len(header) > MOST_COLUMNS:
                    raise SheetError("too_large", f"The sheet has more than {MOST_COLUMNS} columns.")
                yield -1, header
            else:
                if at >= MOST_ROWS:
                    raise SheetError("too_large", f"The sheet has more than {MOST_ROWS} rows.")
                yield at, (cells + [""] * (len(header) - len(cells)))[: len(header)]
            at += 1
        if at <= 0:
            raise SheetError("no_data", "The file has headers but no data rows." if header else "The sheet is empty.")


def sheet_rows(files: DataFrame, strict: bool = True) -> DataFrame:
    """files (path, content) as file, row_index (-1: the header), cells, code and message. A row with a code says why its
    file can't be taken, and rows read before it don't count. Null content is corrupted. strict refuses merged or missing
    headers."""

    def read(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    for at, cells in _sheet(content or b"", strict):
                        rows.append((path, at, cells, None, None))
                        if len(rows) == BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except SheetError as e:
                    rows.append((path, -2, [], *e.args))
                except (zipfile.BadZipFile, KeyError, ValueError, StopIteration, ET.ParseError, IndexError) as e:
                    rows.append((path, -2, [], "corrupted", f"The file could not be opened ({type(e).__name__})."))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return files.select("path", "content").mapInPandas(read, SCHEMA)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def as_table(rows: DataFrame) -> DataFrame:
    """sheet_rows() of files with one header as file, row_index and a text column for each header. Raises SheetError with
    the first file's problem, or if headers differ. Columns without a header and repeats are named by their place."""
    bad = rows.filter("code IS NOT NULL").orderBy("file").first()
    if bad:
        raise SheetError(bad["code"], f"{bad['file']}: {bad['message']}")
    heads = rows.filter("row_index = -1").select("cells").distinct().limit(2).collect()
    if len(heads) != 1:
        raise SheetError("no_data" if not heads else "headers_differ", "The files have no header, or not the same one.")
    taken, names = {"file", "row_index"}, []
    for i, h in enumerate(heads[0]["cells"]):
        names.append(h if h and h.lower() not in taken else f"column_{i + 1}")
        taken.add(names[-1].lower())
    return rows.filter("row_index >= 0").select("file", "row_index", *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def header_warnings(rows: DataFrame) -> DataFrame:
    """file and a message, of files that use a header twice."""
    heads = rows.filter("row_index = -1").select("file", F.posexplode("cells").alias("place", "header")).filter("header <> ''")
    twice = heads.groupBy("file", "header").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")).filter("n > 1")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "header"))), lambda x: x["header"]), ", ")
    return twice.groupBy("file").agg(F.concat(F.lit("Duplicate headers found: "), names, F.lit(".")).alias("message"))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A sheet or folder of sheets by the ending of its name; a sheet without data rows is refused."""
    ending = path.lower().rpartition(".")[2]
    if ending in ("xlsx", "xlsm"):
        return as_table(sheet_rows(workbook_files(spark, path), strict=False))
    if ending != "csv":
        raise SheetError("unsupported", "Only .csv, .xlsx and .xlsm files are supported.")
    rows = scan_csv(spark, path)
    if rows.isEmpty():
        raise SheetError("no_data", "The file has headers but no data rows.")
    return rows


#: Fixed values of the format: the parts of a workbook with one sheet.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Characters that XML can't hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _book(header: list[str], rows) -> bytes:
    """The bytes of a workbook; cells are (text, kind) pairs, and numbers are written as numbers."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(zipfile.ZipInfo(name), text)
        text = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNFIT.sub("", v), {chr(13): "&#13;"})}</t></is></c>'
        cell = lambda v, kind: text(v) if kind == "text" else f"<c><v>{v}</v></c>"
        with book.open(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), "w") as part:
            part.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            part.write(f"<row>{''.join(text(h) for h in header)}</row>".encode())
            for row in rows:
                part.write(f"<row>{''.join(cell(v, k) for v, k in row)}</row>".encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


def as_workbooks(rows: DataFrame, file: str, order: str, columns: list[str]) -> DataFrame:
    """path and content: a workbook of columns (text) for each value of file, rows by order. Whole numbers of at most 15
    digits are written as numbers, all else as text, so that reading gives the same. A workbook is one group, so deal rows to
    files of bounded size first, as pagination.parts does. Nulls are empty cells."""
    whole = lambda c: F.when((text_type(c) == "int") & c.rlike("^(0|-?[1-9]\\d{0,14})$"), "int").otherwise("text")
    cells = F.array(*(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v"), whole(F.coalesce(F.col(c), F.lit(""))).alias("k")) for c in columns))
    dealt = rows.select(F.col(file).cast("string").alias("path"), F.col(order).alias("order"), cells.alias("cells"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        content = _book(columns, ([(x["v"], x["k"]) for x in row] for row in pdf["cells"]))
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [content]})

    return dealt.groupBy("path").applyInPandas(write, "path string, content binary")
