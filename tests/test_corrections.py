"""Corrections: the semantics of each action, and the fold by components against a plain fold of the whole list."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import corrections
from tabulon.operators.components import roots
from tabulon.plans import api
from tabulon.sources import schema

META = schema.TableMeta("Customer", (schema.FieldMeta("customer_name", "Customer Name", required=True), schema.FieldMeta("city", "City")))


def sheet(spark, columns, rows):
    return spark.createDataFrame([(k + 2, *r) for k, r in enumerate(rows)], ", ".join(["__row long", *(f"`{c}` string" for c in columns)]))


def judged(spark, rows, fixes, key="Name", columns=("Name", "City"), sha256=""):
    done = corrections.worked(sheet(spark, columns, rows), key, fixes, sha256)
    return [tuple(r) for r in done.sheet.orderBy("__row").collect()], {k: v["applicable"] for k, v in done.verdicts.items()}, done


ROWS = [("A", "x"), ("B", "y"), ("B", "z"), ("C", None)]


def test_skips_of_one_row_are_all_applicable(spark):
    fixes = [{"id": str(k), "action": "skip_row", "reason": "r", "at": at} for k, at in enumerate(["A", {"row": 2}, "A"])]
    rows, said, _ = judged(spark, ROWS, fixes)
    assert [r[0] for r in rows] == [3, 4, 5] and set(said.values()) == {True}


def test_a_key_of_two_rows_stays_ambiguous_after_one_is_dropped(spark):
    fixes = [{"id": "1", "action": "skip_row", "reason": "r", "at": {"row": 3}}, {"id": "2", "action": "set_value", "at": "B", "column": "City", "value": "new"}]
    rows, said, done = judged(spark, ROWS, fixes)
    assert said == {"1": True, "2": False} and "several rows" in done.verdicts["2"]["why"] and (4, "B", "z") in rows


def test_a_dropped_row_can_be_dropped_by_a_merge_but_not_kept_or_set(spark):
    fixes = [
        {"id": "1", "action": "skip_row", "reason": "r", "at": {"row": 3}},
        {"id": "2", "action": "merge_rows", "keep": {"row": 4}, "drop": [{"row": 3}], "field_overrides": {"City": "both"}},
        {"id": "3", "action": "merge_rows", "keep": {"row": 3}, "drop": [{"row": 2}]},
        {"id": "4", "action": "set_value", "at": {"row": 3}, "column": "City", "value": "q"},
        {"id": "5", "action": "merge_rows", "keep": {"row": 2}, "drop": ["A"]},
        {"id": "6", "action": "merge_rows", "keep": {"row": 2}, "drop": [{"row": 99}], "field_overrides": {"City": "no"}},
    ]
    rows, said, _ = judged(spark, ROWS, fixes)
    assert said == {"1": True, "2": True, "3": False, "4": False, "5": False, "6": False}
    assert rows == [(2, "A", "x"), (4, "B", "both"), (5, "C", None)]


def test_first_sighting_is_recorded_and_compared(spark):
    fixes = [{"action": "set_value", "at": "A", "column": "City", "value": "new"}, {"action": "dismiss_conflict", "reason": "r", "conflict": "k"}]
    _, said, done = judged(spark, ROWS, fixes, sha256="s1")
    first = done.corrections[0]
    assert said == {"c1": True, "c2": True} and (first["id"], first["from"], first["key_column"], first["source_sha256"]) == ("c1", "x", "Name", "s1")
    rows, said, later = judged(spark, [("A", "edited"), *ROWS[1:]], done.corrections, sha256="s2")
    assert said == {"c1": False, "c2": True} and "edited" in later.verdicts["c1"]["why"] and rows[0] == (2, "A", "edited")
    assert later.corrections[0]["source_sha256"] == "s1"


def test_row_numbers_hold_for_one_source_only(spark):
    fixes = [{"id": "1", "action": "skip_row", "reason": "r", "at": {"row": 2}, "source_sha256": "old"}, {"id": "2", "action": "skip_row", "reason": "r", "at": "C", "source_sha256": "old"}]
    _, said, _ = judged(spark, ROWS, fixes, sha256="new")
    assert said == {"1": False, "2": True}
    assert set(judged(spark, ROWS, fixes, sha256="old")[1].values()) == {True}


def test_change_key_holds_for_what_follows_and_stays_recorded(spark):
    rows = [("A", "1"), ("B", "2"), ("2", "3")]
    fixes = [
        {"id": "1", "action": "set_value", "at": "2", "column": "City", "value": "by name"},
        {"id": "2", "action": "change_key", "reason": "r", "column": "City"},
        {"id": "3", "action": "skip_row", "reason": "r", "at": "2"},
        {"id": "4", "action": "skip_row", "reason": "r", "at": "A", "key_column": "Name"},
        {"id": "5", "action": "change_key", "reason": "r", "column": "None"},
    ]
    out, said, done = judged(spark, rows, fixes)
    assert out == [(4, "2", "by name")] and said == {"1": True, "2": True, "3": True, "4": True, "5": False}
    assert done.key == "City" and [c.get("key_column") for c in done.corrections[:4]] == ["Name", None, "City", "Name"]


def test_a_written_key_is_what_later_references_find(spark):
    fixes = [{"id": "1", "action": "set_value", "at": "A", "column": "Name", "value": "New"}, {"id": "2", "action": "skip_row", "reason": "r", "at": "New"}, {"id": "3", "action": "skip_row", "reason": "r", "at": "A"}]
    rows, said, _ = judged(spark, ROWS, fixes)
    assert said == {"1": True, "2": True, "3": False} and rows[0][0] == 3


def test_repeated_ids_shapes_and_identity(spark):
    fixes = [{"id": "1", "action": "skip_row", "reason": "r", "at": "A"}, {"id": "1", "action": "skip_row", "reason": "r", "at": "C"}, {"id": "2", "action": "skip_row", "reason": "r", "at": {"row": True}}, {"id": "3", "action": "set_value", "at": "A", "column": "Gone", "value": ""}]
    rows, _, done = judged(spark, ROWS, fixes)
    assert len(rows) == 3 and done.verdicts["1"]["invalid"] and done.verdicts["2"]["invalid"] and done.verdicts["3"]["invalid"]
    one = corrections.added([], {"action": "merge_rows", "keep": "A", "drop": ["B", {"row": 3}], "reason": "r"})
    assert corrections.added(one, {"action": "merge_rows", "keep": "A", "drop": [{"row": 3}, "B"], "reason": "another"}) is one
    again = corrections.added(corrections.revoked(one, one[0]["id"], "now"), {"action": "merge_rows", "keep": "A", "drop": ["B", {"row": 3}], "reason": "r"})
    assert len({c["id"] for c in again}) == 2 == len(again)
    for bad in ({"action": "fly"}, {"action": "skip_row", "at": "A"}, {"action": "merge_rows", "keep": "A", "drop": ["A"]}, {"action": "set_value", "at": "A", "column": "C"}):
        with pytest.raises(ValueError):
            corrections.check(bad)


def plain_fold(rows, fixes, key):
    """The whole list, one after another, over all rows."""
    cells, dropped, verdicts = {n: dict(c) for n, c in rows.items()}, set(), []
    for c in fixes:
        at_key = c.get("key_column") or key
        if c["action"] == "change_key":
            key = c["column"]
            verdicts.append(True)
            continue
        found = []
        for ref in [c["at"]] if "at" in c else [c["keep"], *c["drop"]]:
            hits = [ref["row"]] if isinstance(ref, dict) and ref["row"] in cells else [n for n, r in cells.items() if not isinstance(ref, dict) and r[at_key] == ref]
            found.append(hits[0] if len(hits) == 1 else None)
        ok = None not in found and (c["action"] == "skip_row" or found[0] not in dropped) and (c["action"] != "merge_rows" or found[0] not in found[1:])
        if ok and c["action"] == "set_value":
            ok = c.get("from", cells[found[0]][c["column"]]) == cells[found[0]][c["column"]]
            if ok:
                cells[found[0]][c["column"]] = c["value"]
        elif ok and c["action"] == "skip_row":
            dropped.add(found[0])
        elif ok:
            cells[found[0]].update(c["field_overrides"])
            dropped.update(found[1:])
        verdicts.append(ok)
    return {n: r for n, r in cells.items() if n not in dropped}, verdicts


def many(rnd, count, rows, keys):
    ref = lambda: {"row": rnd.randrange(2, rows + 6)} if rnd.random() < 0.5 else f"k{rnd.randrange(keys)}"
    out = []
    for _ in range(count):
        kind = rnd.random()
        if kind < 0.5:
            column = rnd.choice(["Name", "Code", "City"])
            c = {"action": "set_value", "at": ref(), "column": column, "value": f"k{rnd.randrange(keys)}"}
            out.append(c | ({"from": f"k{rnd.randrange(keys)}"} if rnd.random() < 0.3 else {}))
        elif kind < 0.7:
            out.append({"action": "skip_row", "reason": "r", "at": ref()})
        elif kind < 0.95:
            out.append({"action": "merge_rows", "keep": ref(), "drop": [ref() for _ in range(rnd.randrange(3))], "field_overrides": {"Name": f"k{rnd.randrange(keys)}"} if rnd.random() < 0.5 else {}})
            if out[-1]["keep"] in out[-1]["drop"]:
                out.pop()
        else:
            out.append({"action": "change_key", "reason": "r", "column": rnd.choice(["Name", "Code"])})
    return out


@pytest.mark.parametrize("seed, keys", [(1, 30), (2, 400), (3, 3)])
def test_components_against_a_plain_fold(spark, seed, keys):
    rnd = random.Random(seed)
    cells = {n + 2: {"Name": f"k{rnd.randrange(keys)}", "Code": f"k{rnd.randrange(keys)}", "City": f"k{rnd.randrange(keys)}"} for n in range(300)}
    fixes = many(rnd, 250, 300, keys)
    rows = spark.createDataFrame([(n, *c.values()) for n, c in cells.items()], "__row long, Name string, Code string, City string")
    out, verdicts = plain_fold(cells, fixes, "Name")
    for apart in (True, False):
        done = corrections.fold(rows, "Name", corrections.as_table(spark, fixes), apart=apart)
        assert [r["applicable"] for r in done.verdicts.orderBy("seq").collect()] == verdicts
        assert {r["__row"]: {h: r[h] for h in ("Name", "Code", "City")} for r in corrections.applied(rows, done).collect()} == out


def test_hundred_thousand_corrections(spark):
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    rows = orders.select((F.col("o_orderkey") + 2).alias("__row"), F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderstatus").alias("status"))
    number = (F.col("__row") + F.when(F.col("__row") % 3 == 0, 1).otherwise(0)).cast("string")
    body = F.concat(F.lit('{"action": "set_value", "column": "status", "value": "X", "from": "O", "at": {"row": '), number, F.lit("}}"))
    fixes = rows.filter("__row % 3 < 2 and __row < 150000").select(F.col("__row").alias("seq"), body.alias("body"))
    assert fixes.count() > 99_000
    done = corrections.fold(rows, "cust", fixes)
    cells = {r["__row"]: {"status": r["status"]} for r in rows.collect()}
    listed = [json.loads(r["body"]) for r in fixes.orderBy("seq").collect()]
    _, verdicts = plain_fold(cells, listed, "status")
    assert [r["applicable"] for r in done.verdicts.orderBy("seq").collect()] == verdicts


def test_an_edited_sheet_makes_row_references_inert_and_answers_stale(spark):
    rows = [("A", "x"), ("A", "y"), ("B", "z")]
    target = spark.createDataFrame([], "customer_name string")
    fix = [{"action": "skip_row", "reason": "r", "at": {"row": 3}, "conflict": "duplicate_key:Customer Name"}]
    run = lambda rows, fixes, **kw: api.import_sheet(sheet(spark, ("Customer Name", "City"), rows), META, target, {}, id_field="customer_name", fixes=fixes, **kw)
    first = run(rows, fix)
    assert first.corrections[0]["source_sha256"] == first.sha256 != ""
    same = run(rows, first.corrections, previous_sha256=first.sha256)
    assert same.sha256 == first.sha256 and same.verdicts["c1"]["applicable"]
    edited = run([("New", "n"), *rows], first.corrections, previous=first.conflicts, previous_sha256=first.sha256)
    assert not edited.verdicts["c1"]["applicable"] and edited.create.count() == 3


def test_a_common_key_and_lone_corrections_link_nothing(spark, monkeypatch):
    """Only corrections that can see each other are linked: neither those that name a key of many rows nor those alone with their row."""
    seen = []
    monkeypatch.setattr(corrections, "roots", lambda edges: (seen.append(edges.count()), roots(edges))[1])
    cells = {n + 2: {"Name": "common" if n < 40 else f"k{n}", "City": "x"} for n in range(100)}
    fixes = [{"action": "set_value", "at": "common", "column": "City", "value": str(k)} for k in range(30)] + [{"action": "set_value", "at": {"row": n}, "column": "City", "value": "y"} for n in range(2, 90)]
    fixes += [{"action": "skip_row", "reason": "r", "at": {"row": 5}}, {"action": "set_value", "at": "k95", "column": "City", "value": "z"}]
    rows = spark.createDataFrame([(n, *c.values()) for n, c in cells.items()], "__row long, Name string, City string")
    done = corrections.fold(rows, "Name", corrections.as_table(spark, fixes))
    out, verdicts = plain_fold(cells, fixes, "Name")
    assert [r["applicable"] for r in done.verdicts.orderBy("seq").collect()] == verdicts and verdicts.count(False) == 30
    assert {r["__row"]: {h: r[h] for h in ("Name", "City")} for r in corrections.applied(rows, done).collect()} == out
    assert seen == [1]
