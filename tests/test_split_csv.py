"""The split CSV scan against the standard library's reader of the whole file."""

import csv
import io
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tabulon.sources import files, split_csv


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("300", "0", "1"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plain(text, delimiter=","):
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=None), delimiter=delimiter) if any(c.strip() for c in r)]
    width = len(rows[0])
    return [(k + 2, *((c or None) for c in (r + [""] * width)[:width])) for k, r in enumerate(rows[1:])]


def cell(rnd):
    kind = rnd.randrange(8)
    if kind < 3:
        return rnd.choice(["", "x", "plain text", " ", 'a "quoted" word', "5'"])
    body = "".join(rnd.choice(["a", "b ", ",", "\n", "\r\n", '""', "é", ";"]) for _ in range(rnd.randrange(12)))
    return f'"{body}"' + rnd.choice(["", "", "tail", 'ta"il'])


def messy(seed, rows=400):
    rnd = random.Random(seed)
    lines = ["﻿Name,Note,Third"]
    for _ in range(rows):
        lines.append(",".join(cell(rnd) for _ in range(rnd.randrange(1, 5))))
        if rnd.random() < 0.05:
            lines.append(rnd.choice(["", ",,", ' , " ",']))
    lines.insert(50, 'long,"' + "inside a cell, over many blocks\n" * 60 + '",end')  # whole blocks lie in it
    return rnd.choice(["\n", "\r\n"]).join(lines)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_that_cut_cells(spark, tmp_path, small_blocks, seed):
    text = messy(seed)
    (tmp_path / "s.csv").write_bytes(text.encode())
    read = files.read_source(spark, str(tmp_path / "s.csv"))
    assert read.columns == ["__row", "Name", "Note", "Third"]
    assert sorted(tuple(r) for r in read.collect()) == plain(text)
    assert spark.read.text(str(tmp_path / "s.csv")).rdd.getNumPartitions() >= 8


def test_a_cell_that_never_ends(spark, tmp_path, small_blocks):
    text = 'A,B\n1,2\n3,"open\n' + "and on\n" * 200
    (tmp_path / "s.csv").write_text(text)
    assert sorted(tuple(r) for r in files.read_source(spark, str(tmp_path / "s.csv")).collect()) == plain(text)


def test_a_header_over_several_blocks(spark, tmp_path, small_blocks):
    text = "\n\n" + 'A,"' + "long name\n" * 100 + '",C\n1,2,3\n'
    (tmp_path / "s.csv").write_text(text)
    read = files.read_source(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in read.collect()] == [(2, "1", "2", "3")] and len(read.columns) == 4 and read.columns[2].startswith("long name")


def test_rows_follow_file_names_not_sizes(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k, n in enumerate((3, 500, 40)):
        (folder / f"part-{k}.csv").write_text("K,V\n" + "".join(f"{k},{i}\n" for i in range(n)))
    before = [tuple(r)[1:] for r in files.read_source(spark, str(folder)).orderBy("__row").collect()]
    assert before == [(str(k), str(i)) for k, n in enumerate((3, 500, 40)) for i in range(n)]
    (folder / "part-2.csv").write_text("K,V\n" + "".join(f"2,{i}\n" for i in range(9000)))  # now the largest, so dealt out first
    after = {r["__row"]: (r["K"], r["V"]) for r in files.read_source(spark, str(folder)).collect()}
    assert [after[k + 2] for k in range(543)] == before and len(after) == 9503


def test_empty_and_blank_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "b.csv").write_text('\n , \n" "\n')
    for name in ("e", "b"):
        with pytest.raises(ValueError):
            files.read_source(spark, str(tmp_path / f"{name}.csv"))
    (tmp_path / "h.csv").write_text("only,header\n")
    assert files.read_source(spark, str(tmp_path / "h.csv")).count() == 0


def test_documents_as_one_quoted_file(spark, tmp_path, small_blocks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect()
    with open(tmp_path / "d.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL)
        out.writerow(["doc_id", "text"])
        out.writerows(docs)
    got = {int(r["doc_id"]): (r["__row"], r["text"] or "") for r in files.read_source(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {d: (k + 2, t.replace("\r\n", "\n").replace("\r", "\n")) for k, (d, t) in enumerate(docs)}


def test_states():
    for size in range(7):
        for line in map("".join, itertools.product('a",', repeat=size)):
            rows = list(csv.reader([line + "\n", "MARK\n"])), list(csv.reader(['"\n', line + "\n", "MARK\n"]))
            assert [split_csv.ends_inside(line, inside, ",") for inside in (False, True)] == [r[1:] != [["MARK"]] for r in rows], line
