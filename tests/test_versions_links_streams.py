"""Copy-on-write tables, all link columns in one pass, and folds of a growing log."""

import json

import pytest
from pyspark.sql import functions as F

from tabulon.operators import journal, links
from tabulon.sources import versions
from tabulon.streaming import logs

SF = "/root/testdata/sf0.01"


def test_a_clustered_patch_rewrites_only_files_that_hold_its_keys(spark, tmp_path):
    path, orders = str(tmp_path / "orders"), spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    versions.create(orders.repartitionByRange(20, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    n = orders.count()
    patch = orders.filter(f"o_orderkey >= {n // 2} and o_orderkey < {n // 2 + n // 100}").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    before = set(versions.files_of(spark, path))
    change = versions.update(spark, path, patch, "o_orderkey")
    after = set(versions.files_of(spark, path))
    assert change.version == 2 and change.rewritten <= 2 and change.kept >= 18 and len(before & after) == change.kept
    assert sorted(map(tuple, versions.read(spark, path).collect())) == sorted((k, c, "X" if n // 2 <= k < n // 2 + n // 100 else s) for k, c, s in orders.collect())
    assert versions.read(spark, path, 1).filter("o_orderstatus = 'X'").count() == 0  # the old version is still whole
    assert sorted(map(tuple, versions.before(spark, path, patch, "o_orderkey", 1).collect())) == sorted(map(tuple, orders.join(patch.select("o_orderkey"), "o_orderkey").select("o_orderkey", "o_orderstatus").collect()))
    assert versions.update(spark, path, patch.limit(0), "o_orderkey") == versions.Change(2, 0, len(after))
    gone = versions.delete(spark, path, orders.filter("o_orderkey < 10"), "o_orderkey")
    assert gone.rewritten == 1 and versions.read(spark, path).count() == n - 10
    versions.append(orders.filter("o_orderkey < 10"), path)
    assert versions.read(spark, path).count() == n
    assert versions.cleared(spark, path) == change.rewritten + gone.rewritten and versions.read(spark, path).count() == n


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.version_of(spark, path)
    versions.create(spark.range(5).toDF("k"), path)
    with pytest.raises(RuntimeError, match="another writer"):
        versions.create(spark.range(9).toDF("k"), path)
    assert versions.read(spark, path).count() == 5


def test_problems_of_all_link_columns(spark):
    columns = [f"l{k}" for k in range(8)]
    rows = spark.createDataFrame([(2, *["a", "b", " c ", "", None, "x", "g", "new"], "new"), (3, *["z", "b", "c", "y", "a", "x", "a", "a"], "a")], "__row long, " + ", ".join(f"{c} string" for c in columns) + ", own string")
    tables = {"T": spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("g", 1)], "name string, is_group int"), "U": spark.createDataFrame([("x",), ("mapped",)], "name string")}
    asked = [links.LinkColumn(c, "U" if k == 5 else "Unread" if k == 4 else "T", f"f{k}", f"f{k}" if k in (2, 6) else "", {"z": "b"} if k == 0 else None, "own" if k == 7 else None) for k, c in enumerate(columns)]
    found = links.link_problems(rows, asked, tables)
    got = {(r["kind"], r["header"]): (r["target"], r["count"], r["values"]) for r in found.collect()}
    assert got == {("link_value_conflict", "l3"): ("f3", 1, ["y"]), ("link_group_node", "l2"): ("f2", 1, ["c"]), ("link_group_node", "l6"): ("f6", 1, ["g"])}
    assert links.link_problems(rows, [], tables).count() == 0


def test_the_plan_scans_the_sheet_once(spark, tmp_path, capsys):
    spark.range(100).select((F.col("id") + 2).alias("__row"), *(F.col("id").cast("string").alias(f"l{k}") for k in range(8))).write.parquet(str(tmp_path / "sheet"))
    rows, names = spark.read.parquet(str(tmp_path / "sheet")), {"T": spark.createDataFrame([("1",)], "name string")}
    columns = [links.LinkColumn(f"l{k}", "T", "f") for k in range(8)]
    found = links.link_problems(rows, columns, names)
    assert {r["header"]: r["count"] for r in found.collect()} == {f"l{k}": 99 for k in range(8)}
    found.explain("simple")
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan  # both uses of what was found share the exchange of the stacked cells


IDENTITY = ("kind", "source", "target", "doctype", "field")
SCHEMA = "seq long, event string, via string, " + ", ".join(f"{c} string" for c in IDENTITY)


def test_requirements_after_each_batch_are_the_fold_of_what_has_arrived(spark, tmp_path):
    folder, state, checkpoint = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    folder.mkdir()
    line = lambda seq, event, source, via=None: json.dumps({"seq": seq, "event": event, "kind": "unmapped", "source": source, "via": via})
    batches = [
        [line(1, "requirement", "a"), line(2, "requirement", "b"), "broken {"],
        [line(5, "requirement_satisfied", "a", "effect"), line(3, "other", "a"), line(6, "requirement", "c")],
        [line(4, "requirement", "a"), line(8, "requirement", "a")],  # the first is late
        [line(7, "requirement_satisfied", "b", "late"), line(9, "requirement_satisfied", "b", "config")],
    ]
    for k, lines in enumerate(batches):
        (folder / f"{k}.jsonl").write_text("\n".join(lines) + "\n")
        log = logs.follow(spark, str(folder), SCHEMA)
        logs.running_requirements(log, state, checkpoint).awaitTermination(120)
        columns = [*IDENTITY, "state", "met", "via"]
        batch = journal.requirement_state(journal.read_log(spark, str(folder), SCHEMA))
        assert sorted(map(tuple, logs.requirements(spark, state).select(*columns).collect()), key=str) == sorted(map(tuple, batch.select(*columns).collect()), key=str)
    assert {r["source"]: (r["state"], r["met"], r["via"]) for r in logs.requirements(spark, state).collect()} == {"a": ("reopened", 1, "effect"), "b": ("satisfied", 2, "config"), "c": ("open", 0, None)}
