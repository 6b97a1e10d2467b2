"""Workbooks: Office Open XML read with the standard library, by way of Spark's binary files, so any store works.

A workbook is one compressed file of one sheet stream each, so a sheet is parsed by one task; sheets run in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.sources.files import _header, cast_by_cells

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """The number of a cell's column, from letters."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_files(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names in order, and the member that holds each."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): (t[1:] if (t := links[s.get(RELATION)]).startswith("/") else f"xl/{t}") for s in sheets}


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet (the first by default) as text; blank cells are None, rows are as long as their last cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        files = sheet_files(book)
        member = next(iter(files.values())) if sheet is None else {n.lower(): f for n, f in files.items()}[sheet.lower()]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        with book.open(member) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = cell.find(f"{MAIN}v")
                    text = None if value is None else value.text
                    if cell.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    elif cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif cell.get("t") == "b" and text is not None:
                        text = "true" if text == "1" else "false"
                    cells[at] = text if text != "" else None
                row.clear()
                yield cells


def sheets(spark: SparkSession, path: str) -> list[str]:
    content = spark.read.format("binaryFile").load(path).first().content
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        return list(sheet_files(book))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, typed: bool = True) -> DataFrame:
    """A sheet as a table: the first row names the columns, short rows are filled with null."""
    files = spark.read.format("binaryFile").load(path)
    first = next(sheet_rows(bytes(files.first().content), sheet), [])
    names = _header([x or "" for x in first]) or ["column_1"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = sheet_rows(content.as_py(), sheet)
                next(rows, None)
                held = []
                for row in rows:
                    held.append([*row[: len(names)], *[None] * (len(names) - len(row))])
                    if len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)

    df = files.select("content").mapInArrow(run, schema)
    return cast_by_cells(df) if typed else df


def write_book(tables: dict[str, list[list]]) -> bytes:
    """A small workbook of text and number cells: for tests and exports of results."""
    out = io.BytesIO()
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = list(tables)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{RELATION[1:-3]}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, n in enumerate(names, 1):
            rows = "".join("<row>" + "".join("<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{esc(v)}</t></is></c>' for v in row) + "</row>" for row in tables[n])
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()
