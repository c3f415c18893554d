"""Workbooks: read as binary files by Spark and parsed in tasks with the standard library; written as one workbook per bounded run of rows.

A sheet holds 1 048 576 rows at most, so a workbook is a bounded piece of work.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileError, TooLargeError
from .delimited import headers_of

MAX_ROWS = 1_048_576
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def cell_text(value) -> str | None:
    """A cell as text: booleans as true and false, midnight date-times as dates, whole floats without a point, empty as null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat(sep=" ")
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(value)
    out = str(value).lstrip("﻿")
    return out or None


def sheet_names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _dates(z: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    xfs = root.find(f"{_NS}cellXfs")
    return [int(x.get("numFmtId", 0)) in own | _DATE_FORMATS for x in xfs] if xfs is not None else []


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet, the first one by default; cached values of formulas, which are never evaluated."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = {s.get("name"): s.get(_REL) for s in book.iter(f"{_NS}sheet")}
        name = sheet if sheet is not None else next(iter(sheets), None)
        if name not in sheets:
            raise FileError(f"no sheet named {name}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheets[name]].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        dates = _dates(z)
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells)) + [cell_text(_value(c, shared, dates))]
                yield cells
                row.clear()


def _value(c, shared: list[str], dates: list[bool]):
    kind, v = c.get("t", "n"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    style = int(c.get("s", 0))
    if style < len(dates) and dates[style]:
        return dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(number * 86400))
    return number if "." in v.text or "E" in v.text.upper() else int(v.text)


def _parse(sheet: str | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list = []
                for i, cells in enumerate(sheet_rows(data.as_py(), sheet)):
                    rows.append((i, cells))
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return kernel


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["at", "cells"])


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, max_bytes: int | None = None) -> tuple[DataFrame, dict]:
    """(row_index, columns as text) and {columns, sheet_names, file_type}; made-up columns at the end without a value are dropped."""
    files = spark.read.format("binaryFile").load(path)
    meta = files.select("length").take(1)
    if not meta or not meta[0]["length"]:
        raise FileError(f"{path} is empty")
    if max_bytes is not None and meta[0]["length"] > max_bytes:
        raise TooLargeError(f"{path} has {meta[0]['length']} bytes; {max_bytes} are allowed")
    raw = files.select("content").mapInArrow(_parse(sheet), "at long, cells array<string>")
    kept = raw.where(F.exists("cells", lambda c: c.isNotNull()))
    first = kept.orderBy("at").take(1)
    if not first:
        raise FileError(f"{path} has no rows")
    columns = headers_of(first[0]["cells"])
    body = kept.where((F.col("at") > first[0]["at"]) & (F.concat_ws("", F.slice("cells", 1, len(columns))) != ""))
    body = body.select("at", *[F.get("cells", F.lit(i)).alias(f"_c{i}") for i in range(len(columns))])
    counts = body.agg(*[F.count(f"_c{i}").alias(f"_c{i}") for i in range(len(columns))]).first()
    while columns and re.fullmatch(r"Column \d+", columns[-1]) and not counts[f"_c{len(columns) - 1}"]:
        columns.pop()
    from pyspark.sql import Window

    # one sheet is at most MAX_ROWS rows
    out = body.withColumn("row_index", F.row_number().over(Window.orderBy("at")).cast("long") - 1).select("row_index", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
    names = files.select("content").mapInArrow(_names, "name string").collect()
    return out, {"columns": columns, "sheet_names": [r["name"] for r in names], "file_type": "xlsx"}


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(sheet_names(data.as_py()), pa.string())], names=["name"])


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet(rows: list[list[str | None]], widths: list[int] | None = None, frozen: bool = False) -> str:
    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{_letters(c)}{r}" t="inlineStr"{" s=" + chr(34) + "1" + chr(34) if r == 1 else ""}><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(cells) if v is not None) + "</row>" for r, cells in enumerate(rows, 1))
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if frozen else ""
    cols = "<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1)) + "</cols>" if widths else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}">{pane}{cols}<sheetData>{body}</sheetData></worksheet>'


def workbook(headers: list[str], rows: list[list[str | None]], report: list[tuple[str, str]] = ()) -> bytes:
    """A sheet ``Data`` of text cells under a frozen header, and a sheet ``Import Report``."""
    clean = lambda v: None if v is None else re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    table = [[clean(h) for h in headers], *[[clean(v) for v in r] for r in rows]]
    widths = [min(40, max(12, 2 + max(len(r[i] or "") for r in table[:201]))) for i in range(len(headers))]
    parts = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS[1:-1]}" xmlns:r="{_REL[1:-3]}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Import Report" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet2.xml"/><Relationship Id="rId3" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_NS[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": _sheet(table, widths, True),
        "xl/worksheets/sheet2.xml": _sheet([[str(a), str(b)] for a, b in report]),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbooks(rows: DataFrame, fields: list[str], report: list[tuple[str, str]] = (), rows_each: int = 100_000) -> DataFrame:
    """rows (row_index, fields) -> (book, content): a workbook for each bounded run of rows, made in tasks."""
    rows_each = min(rows_each, MAX_ROWS - 1)

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_index")
        data = [list(r) for r in zip(*(table[f].to_pylist() for f in fields), strict=True)]
        return pa.table({"book": [table["book"][0].as_py()], "content": [workbook(fields, data, list(report))]}, schema=pa.schema([("book", pa.int64()), ("content", pa.binary())]))

    numbered = rows.select("row_index", *[F.col(f).cast("string").alias(f) for f in fields], F.expr(f"row_index div {rows_each}").alias("book"))
    return numbered.groupBy("book").applyInArrow(make, "book long, content binary")
