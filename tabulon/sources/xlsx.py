"""The first sheet of an .xlsx or .xlsm file, with the standard library only.

The file's bytes come through Spark's binary reader, so it can lie in any store that Spark reads.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.profile import ROW
from tabulon.sources.shared import written
from tabulon.sources.split_csv import first_names

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def number_text(value: str, is_date: bool) -> str:
    """A number as a sheet shows it: whole ones without point, dates as ISO text."""
    x = float(value)
    if is_date:
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(x * 86400))
        return moment.strftime("%Y-%m-%d %H:%M:%S")
    return str(int(x)) if x.is_integer() else repr(x)


def rows_of(data: bytes) -> list[list[str]]:
    """The cells of the first sheet as text; blank rows are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        parse = lambda name: ElementTree.fromstring(book.read(name))
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
        shared = [text(s) for s in parse("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dates = []
        if "xl/styles.xml" in names:
            styles = parse("xl/styles.xml")
            own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower() for f in styles.iter(f"{MAIN}numFmt")}
            cells = styles.find(f"{MAIN}cellXfs")
            for xf in cells if cells is not None else ():
                number = int(xf.get("numFmtId", "0"))
                dates.append(number in DATE_FORMATS or bool(re.search("[ymdhs]", own.get(number, ""))))
        first = parse("xl/workbook.xml").find(f"{MAIN}sheets")[0].get(f"{REL}id")
        targets = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
        sheet = parse(f"xl/{targets[first].removeprefix('/xl/')}")
    out = []
    for row in sheet.iter(f"{MAIN}row"):
        cells: dict[int, str] = {}
        for k, cell in enumerate(row.iter(f"{MAIN}c")):
            kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
            if kind == "inlineStr":
                shown = text(cell)
            elif value is None:
                continue
            elif kind == "s":
                shown = shared[int(value)]
            elif kind == "b":
                shown = "True" if value == "1" else "False"
            elif kind == "n":
                style = int(cell.get("s", "0"))
                shown = number_text(value, style < len(dates) and dates[style])
            else:
                shown = value
            cells[column_number(cell.get("r")) if cell.get("r") else k] = shown
        if any(v.strip() for v in cells.values()):
            out.append([cells.get(k, "") for k in range(max(cells) + 1)])
    return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of a workbook, or of a folder's workbooks in the order of their names; each has a header, the first one's counts.

    A workbook holds at most 1,048,576 rows a sheet, so one is one task's; its rows go to the shared folder, not to the driver.
    """

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = rows_of(bytes(content.as_buffer()))
                for low in range(0, len(rows), 10_000):
                    part = rows[low : low + 10_000]
                    columns = [pa.array([name.as_py()] * len(part)), pa.array(range(low, low + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "at", "cells"])

    books = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = written(books.mapInArrow(parse, "file string, at long, cells array<string>"), "workbook")
    before, starts = 0, []
    for file, n in sorted(tuple(r) for r in rows.groupBy("file").count().collect()):  # one row a workbook
        starts.append((file, before))
        before += n - 1
    if not starts:
        raise ValueError(f"{path} is empty")
    names = first_names(rows.filter((F.col("file") == starts[0][0]) & (F.col("at") == 0)).first()["cells"])
    numbered = rows.filter("at > 0").join(F.broadcast(spark.createDataFrame(starts, "file string, before long")), "file")
    cells = [F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)]
    return numbered.select((F.col("at") + F.col("before") + 1).alias(ROW), *cells)
