"""One large CSV read by many tasks, though quoted cells hold line breaks.

A line is read in one of two states: outside a quoted cell or inside one. Each block of a file (a byte range that
Spark reads) is scanned for both, which gives it a map from its first state to its last; the maps, one row a block,
are composed in the order of the blocks. Then each block reads its records from its true state. A record that the
end of a block cuts leaves pieces, at most two a block, that are joined afterwards.

Where a cell isn't quoted from its start, quotes in it are text; after a closing quote the rest of the cell is text,
too. A line ends at \\n, \\r or \\r\\n, also within a cell, where it counts as \\n.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.profile import ROW
from tabulon.sources.shared import new_folder, stored

WHOLE, OPENED, CONTINUED = 0, 1, 2
PLACE = ("path", "start")


def sniff_delimiter(line: str) -> str:
    """Of tab, semicolon and comma the first that the header line holds."""
    return next((d for d in ("\t", ";", ",") if d in line), ",")


def first_names(names: list[str]) -> list[str]:
    """Stripped headers; a repeated one gets its position, so that the first keeps the name."""
    seen: dict[str, int] = {}
    out = []
    for k, name in enumerate(n.strip() for n in names):
        out.append(f"{name}__{k + 1}" if name in seen or not name else name)
        seen.setdefault(name, k)
    return out


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open at the end of the line."""
    at, size = 0, len(line)
    while True:
        if not inside and (at >= size or line[at] != '"'):  # a cell without quotes
            at = line.find(delimiter, at)
        else:
            at = line.find('"', at if inside else at + 1)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
            inside, at = False, line.find(delimiter, at + 1)
        if at < 0:
            return False
        at += 1


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(path, start, lines) from batches of (path, start, line) in the file's order; a block may come in several parts."""
    for batch in batches:
        paths, starts, lines = (batch.column(i).to_pylist() for i in range(3))
        low = 0
        while low < len(lines):
            high = low
            while high < len(lines) and starts[high] == starts[low] and paths[high] == paths[low]:
                high += 1
            yield paths[low], starts[low], lines[low:high]
            low = high


def block_maps(lines: DataFrame, delimiter: str) -> DataFrame:
    """path, start, from_outside, from_inside (whether the block ends inside a cell), unbroken (from inside, no record ends in it)."""

    def scan(batches):
        last, states, unbroken = None, [False, True], True

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, *states, unbroken)], names=[*PLACE, "from_outside", "from_inside", "unbroken"])

        for path, start, part in blocks_of(batches):
            if last and last != (path, start):
                yield row()
                states, unbroken = [False, True], True
            last = (path, start)
            for line in part:
                if '"' in line:
                    states = [ends_inside(line, s, delimiter) for s in states]
                    unbroken = unbroken and states[1]
        if last:
            yield row()

    return lines.mapInArrow(scan, "path string, start long, from_outside boolean, from_inside boolean, unbroken boolean")


def first_states(maps: list[tuple[str, int, bool, bool, bool]]) -> tuple[dict[tuple[str, int], tuple[int, bool, int]], bool]:
    """Of each block its number, whether it begins inside a cell, and the number of the block where that record begins; whether any block ends inside one."""
    out, inside, opener, before, cut = {}, False, 0, None, False
    for number, (path, start, from_outside, from_inside, unbroken) in enumerate(sorted(maps)):
        inside, before = inside and path == before, path
        out[path, start] = (number, inside, opener if inside else number)
        if not (inside and unbroken):  # else the record goes on
            opener = number
        inside = from_inside if inside else from_outside
        cut = cut or inside
    return out, cut


def parsed(lines: DataFrame, delimiter: str, width: int, states: dict[tuple[str, int], tuple[int, bool, int]]) -> DataFrame:
    """block, at, kind, opener, piece, c0, c1, ...: the filled records of each block, counted from 0, and its pieces of cut records."""
    known = lines.sparkSession.sparkContext.broadcast(states)  # one entry a block

    def read(batches):
        csv.field_size_limit(sys.maxsize)
        last, block, inside, opener, going_on, at, held = None, 0, False, 0, False, 0, []

        def batch(rows: list[list[str]], first: int, pieces: list[tuple[int, int, str]]):
            n, m = len(rows), len(pieces)
            fixed = [pa.array([block] * (n + m), pa.int32()), pa.array([*range(first, first + n), *([at] * m)], pa.int64()), pa.array([WHOLE] * n + [p[0] for p in pieces], pa.int32())]
            fixed += [pa.array([block] * n + [p[1] for p in pieces], pa.int32()), pa.array([None] * n + [p[2] for p in pieces], pa.string())]
            cells = [pa.array([(r[k] or None) if k < len(r) else None for r in rows] + [None] * m, pa.string()) for k in range(width)]
            return pa.RecordBatch.from_arrays([*fixed, *cells], names=["block", "at", "kind", "opener", "piece", *(f"c{k}" for k in range(width))])

        def rest():
            return [(CONTINUED, opener, "".join(held))] if going_on else [(OPENED, block, "".join(held))]

        for path, start, part in blocks_of(batches):
            if last != (path, start):
                if held:
                    yield batch([], at, rest())
                last, at, held = (path, start), 0, []
                block, inside, opener = known.value[last]
                going_on, part[0] = inside, part[0].removeprefix("\ufeff") if start == 0 else part[0]
            pieces, ready = [], 0
            for line in part:
                held.append(line + "\n")
                inside = ends_inside(line, inside, delimiter) if '"' in line else inside
                if not inside and going_on:
                    pieces, going_on, held = rest(), False, []
                elif not inside:
                    ready = len(held)
            rows = [r for r in csv.reader(held[:ready], delimiter=delimiter) if filled_row(r)]
            first, at, held = at, at + len(rows), held[ready:]
            yield batch(rows, first, pieces)
        if held:
            yield batch([], at, rest())

    cells = ", ".join(f"c{k} string" for k in range(width))
    return lines.mapInArrow(read, f"block int, at long, kind int, opener int, piece string, {cells}")


def joined(pieces: DataFrame, delimiter: str, width: int) -> DataFrame:
    """block, at, c0, c1, ... of the records that block ends cut: one group a record, filed where it begins."""
    whole = pieces.groupBy("opener").agg(F.max(F.when(F.col("kind") == OPENED, F.col("at"))).alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("record"))

    def read(batches):
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            rows = [next(csv.reader([x + "\n" for x in text.split("\n")[:-1]], delimiter=delimiter)) for text in batch.column(2).to_pylist()]
            keep = [filled_row(r) for r in rows]
            cells = [pa.array([(r[k] or None) if k < len(r) else None for r in rows], pa.string()) for k in range(width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], names=["block", "at", *(f"c{k}" for k in range(width))]).filter(pa.array(keep))

    return whole.select(F.col("opener").alias("block"), "at", "record").mapInArrow(read, ", ".join(["block int, at long", *(f"c{k} string" for k in range(width))]))


def filled_row(cells: list[str]) -> bool:
    return any(c.strip() for c in cells)


def header_of(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """(delimiter, cells of the first filled record) of one file; ValueError without one."""
    count = 100
    while True:
        lines = [r[0] for r in spark.read.text(path).select(F.make_valid_utf8("value")).limit(count).collect()]
        lines = [lines[0].removeprefix("\ufeff"), *lines[1:]] if lines else []
        delimiter, inside = sniff_delimiter(lines[0] if lines else ""), False
        for k, line in enumerate(lines):
            inside = ends_inside(line, inside, delimiter)
            if not inside or len(lines) < count:
                found = next((r for r in csv.reader([x + "\n" for x in (lines if inside else lines[: k + 1])], delimiter=delimiter) if filled_row(r)), None)
                if found:
                    return delimiter, found
        if len(lines) < count:
            raise ValueError(f"{path} has no rows")
        count *= 10


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """The sheet in a CSV file or folder, parsed once into the shared folder; rows are numbered by file name, then by place.

    Each file has a header, the first one's counts. Cells beyond it are dropped.
    """
    text = spark.read.text(path)
    files = sorted(text.inputFiles())
    if not files:
        raise ValueError(f"{path} is empty")
    delimiter, header = header_of(spark, files[0])
    width = len(header)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("line"))
    maps = [tuple(r) for r in block_maps(lines, delimiter).collect()]  # one row a block
    states, cut = first_states(maps)
    table = stored(parsed(lines, delimiter, width, states), new_folder(spark, "csv"))
    cells = [f"c{k}" for k in range(width)]
    rows = table.filter(F.col("kind") == WHOLE).select("block", "at", *cells)
    if cut:
        rows = rows.unionByName(joined(table.filter(F.col("kind") != WHOLE), delimiter, width))
    of, places, total, seen = {number: path for (path, _), (number, _, _) in states.items()}, [], 0, set()
    for block, n in sorted(tuple(r) for r in rows.groupBy("block").count().collect()):  # one row a block
        header_rows = int(of[block] not in seen)
        seen.add(of[block])
        places.append((block, total - header_rows, header_rows))
        total += n - header_rows
    offsets = spark.createDataFrame(places, "block int, before long, header_rows int")
    numbered = rows.join(F.broadcast(offsets), "block").filter("at >= header_rows")
    return numbered.select((F.col("at") + F.col("before") + 2).alias(ROW), *(F.col(c).alias(n) for c, n in zip(cells, first_names(header), strict=True)))
