"""Excel workbooks (.xlsx) as tables of strings, read from the zip and its XML as streams.

Files come through Spark's binary reader, so they may be in any store that Spark reads; each
file is one task's, since a sheet's rows can only be read in order (it holds 1,048,576 at most).
All cells are strings: texts as they are, leading zeros included; whole numbers without a point;
true and false as True and False. Empty cells and error cells are null. Dates are the numbers
that the file holds. The first row with a cell is the header.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = 2000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _shared(book: zipfile.ZipFile) -> list[str]:
    """The workbook's shared strings; a rich one is the text of all its runs, without phonetic hints."""
    out: list[str] = []
    if "xl/sharedStrings.xml" not in book.namelist():
        return out
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in iterparse(f):
            if _local(e.tag) == "rPh":
                e.clear()
            elif _local(e.tag) == "si":
                out.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
                e.clear()
    return out


def _sheet(book: zipfile.ZipFile, name: str | None) -> str:
    """The path of the named sheet, or of the first."""
    with book.open("xl/workbook.xml") as f:
        sheets = [(e.get("name"), next(v for k, v in e.attrib.items() if _local(k) == "id")) for _, e in iterparse(f) if _local(e.tag) == "sheet"]
    with book.open("xl/_rels/workbook.xml.rels") as f:
        targets = {e.get("Id"): e.get("Target") for _, e in iterparse(f) if _local(e.tag) == "Relationship"}
    found = [targets[i] for n, i in sheets if name is None or n == name]
    if not found:
        raise ValueError(f"no sheet {name!r} among {[n for n, _ in sheets]}")
    return found[0].lstrip("/") if found[0].startswith("/") else f"xl/{found[0]}"


def _column(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t") or None
    text = next((v.text for v in cell if _local(v.tag) == "v"), None)
    if text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(text)] or None
    if kind == "b":
        return "True" if text == "1" else "False"
    if kind == "n" and not re.fullmatch(r"-?\d+", text):
        number = float(text)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return text


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet that have a cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        with book.open(_sheet(book, sheet)) as f:
            events = iterparse(f, events=("start", "end"))
            holder = None
            for event, e in events:
                if event == "start":
                    holder = e if _local(e.tag) == "sheetData" else holder
                elif _local(e.tag) == "row":
                    row: list[str | None] = []
                    for cell in e:
                        at = _column(cell.get("r")) if cell.get("r") else len(row)
                        row += [None] * (at + 1 - len(row))
                        row[at] = _value(cell, shared)
                    if any(v is not None for v in row):
                        yield row
                    holder.clear()


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The named sheet, or the first, of the workbooks at path; columns by the header of the first workbook, all strings."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches: Iterator[pa.RecordBatch], skip: int, most: int | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[list[str | None]] = []
                for k, row in enumerate(sheet_rows(content.as_py(), sheet)):
                    if k >= skip:
                        held.append(row)
                    if len(held) >= _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["cells"])
                        held = []
                    if most is not None and k + 1 >= skip + most:
                        break
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["cells"])

    head = files.limit(1).mapInArrow(lambda b: rows(b, 0, 1), "cells array<string>").first()
    if head is None:
        raise ValueError(f"{path}: the first sheet is empty")
    names = [h or f"Unnamed: {k}" for k, h in enumerate(head.cells)]
    body = files.mapInArrow(lambda b: rows(b, 1, None), "cells array<string>")
    return body.select(*(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)))
