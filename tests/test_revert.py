"""Reverting a journal: outcomes, levels, markers, resuming, pruning."""

import json

import pytest

from tabulon.operators import journal, revert

LOG = "seq long, event string, op string, doctype string, name string, fields map<string,string>, link_doctype string, link_name string, status string, reverted long"


def log_of(spark, *effects, extra=()):
    rows = [(k + 1, "effect", op, doctype, name, more.get("fields"), more.get("link_doctype"), more.get("link_name"), None, None) for k, (op, doctype, name, more) in enumerate(effects)]
    return spark.createDataFrame([*rows, *extra], LOG)


def outcomes(done):
    return {r["seq"]: (r["ok"], r["error"]) for r in done.results.collect()}


@pytest.fixture
def tables(spark):
    groups = spark.createDataFrame([("root", None, 1), ("mid", "root", 1), ("leaf", "mid", 0), ("lone", None, 0)], "name string, parent string, is_group int")
    people = spark.createDataFrame([("p", "leaf", [("Group", "leaf"), ("Group", "mid")]), ("q", "root", [])], "name string, team string, links array<struct<link_doctype: string, link_name: string>>")
    return {"Group": groups, "Person": people}


TREE = (revert.Reference("Group", "parent", "Group"), revert.Reference("Person", "team", "Group"))


def test_a_created_parent_goes_after_its_children(spark, tables):
    log = log_of(spark, *(("delete_record", "Group", n, {}) for n in ("root", "mid", "leaf")), ("restore_record", "Person", "p", {"fields": {"team": "lone"}}), ("restore_record", "Person", "q", {"fields": {"team": None}}))
    done = revert.reverted(tables, log, references=TREE, run="r1")
    assert all(ok for ok, _ in outcomes(done).values()) and [r["name"] for r in done.tables["Group"].collect()] == ["lone"]
    assert done.marker.first()["reverted"] == 5 and [r["seq"] for r in done.results.collect()] == [5, 4, 3, 2, 1]


def test_what_is_still_referred_to_stays_with_all_above_it(spark, tables):
    log = log_of(spark, *(("delete_record", "Group", n, {}) for n in ("root", "mid", "leaf", "lone")))
    done = revert.reverted(tables, log, references=TREE)
    got = outcomes(done)
    assert got == {1: (False, "still referred to by Person/q"), 2: (False, "still referred to by Group/leaf"), 3: (False, "still referred to by Person/p"), 4: (True, "")}
    assert done.marker is None and done.applied == 1 and done.tables["Group"].count() == 3


def test_unknown_and_impossible_effects_fail_alone(spark, tables):
    log = log_of(
        spark, ("fly", "Group", "x", {}), (None, None, None, {}), ("restore_record", "Person", "nobody", {"fields": {"team": "x"}}), ("restore_record", "Person", "p", {"fields": {"colour": "x"}}), ("restore_record", "Person", "gone", {"fields": {}}),
        ("delete_record", "Group", "never was", {}), ("delete_record", "Planet", "x", {}), ("remove_record_link", "Person", "p", {"link_doctype": "Group", "link_name": "leaf"}), ("remove_record_link", "Person", "q", {"link_doctype": "Group", "link_name": "no"}),
        ("remove_record_link", "Group", "leaf", {"link_doctype": "Group", "link_name": "no"}), ("delete_custom_field", None, "Person-x", {}), ("correction_revoke", None, "c1", {}),
    )
    done = revert.reverted(tables, log)
    assert {k: ok for k, (ok, _) in outcomes(done).items()} == {1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False, 8: True, 9: True, 10: False, 11: True, 12: True}
    assert outcomes(done)[4][1] == "no field colour" and done.marker is None
    assert [x["link_name"] for x in done.tables["Person"].filter("name = 'p'").first()["links"]] == ["mid"]


def test_a_record_that_goes_first_can_not_be_restored(spark, tables):
    made_last = log_of(spark, ("restore_record", "Person", "p", {"fields": {"team": "x"}}), ("delete_record", "Person", "p", {}))
    made_first = log_of(spark, ("delete_record", "Person", "p", {}), ("restore_record", "Person", "p", {"fields": {"team": "x"}}))
    assert outcomes(revert.reverted(tables, made_last)) == {2: (True, ""), 1: (False, "no record Person/p")}
    assert outcomes(revert.reverted(tables, made_first)) == {2: (True, ""), 1: (True, "")}


def test_markers_resume_and_force(spark, tables):
    log = log_of(spark, ("delete_record", "Group", "leaf", {}), ("delete_record", "Group", "lone", {}))
    part = revert.reverted(tables, log, references=TREE)
    assert part.applied == 1 and part.marker is None
    moved = part.tables | {"Person": part.tables["Person"].filter("name <> 'p'")}
    rest = revert.reverted(moved, log, references=TREE, run="r")
    assert rest.applied == 2 and rest.tables["Group"].count() == 2
    mark = rest.marker.first()
    for status, count, already in (("ok", mark["reverted"], True), ("failed", 2, False), ("ok", 1, False)):
        marked = log_of(spark, ("delete_record", "Group", "leaf", {}), ("delete_record", "Group", "lone", {}), extra=[(9, "revert", None, None, None, None, None, None, status, count)])
        again = revert.reverted(tables, marked)
        assert again.already == already and (again.applied == 0) == already
    forced = revert.reverted(tables, log_of(spark, ("delete_record", "Group", "leaf", {}), extra=[(9, "revert", None, None, None, None, None, None, "ok", 1)]), force=True)
    assert not forced.already and forced.tables["Group"].count() == 3


def test_a_dry_run_changes_nothing(spark, tables):
    log = log_of(spark, ("delete_record", "Group", "leaf", {}), ("restore_record", "Person", "p", {"fields": {"team": "x", "a": "y"}}), ("restore_record", "Person", "p", {"fields": {}}), ("fly", "A", "b", {}))
    done = revert.reverted(tables, log, apply=False)
    assert done.tables is tables and done.marker is None and [r["description"] for r in done.results.collect()] == ["unknown effect fly", "restore Person/p (no fields)", "restore Person/p a, team", "delete Group/leaf"]
    empty = revert.reverted(tables, log.limit(0))
    assert (empty.total, empty.applied, empty.marker) == (0, 0, None)


def test_pruning_keeps_what_can_still_be_undone(spark, tmp_path):
    effect, mark = json.dumps({"event": "effect"}) + "\n", json.dumps({"event": "revert", "status": "ok", "reverted": 1}) + "\n"
    for k, text in enumerate([effect, effect + mark, "", "broken\n", effect + json.dumps({"event": "revert", "status": "failed", "reverted": 1}) + "\n", effect, ""]):
        (tmp_path / f"journal-sheet-20240101-00000{k}.jsonl").write_text(text)
    (tmp_path / "other-20230101-000000.jsonl").write_text(effect)
    deleted, kept = revert.prune(spark, str(tmp_path), keep=1, protect=str(tmp_path / "journal-sheet-20240101-000003.jsonl"))
    assert [n[-7] for n in deleted] == ["2", "1"] and [n[-7] for n in kept] == ["0", "4", "5"]
    assert len(list(tmp_path.glob("*.jsonl"))) == 6 and revert.prune(spark, str(tmp_path / "none")) == ([], [])


def test_levels_of_a_long_chain(spark):
    n = 40
    chain = spark.createDataFrame([(f"g{k}", f"g{k - 1}" if k else None) for k in range(n)], "name string, parent string")
    log = log_of(spark, *(("delete_record", "Group", f"g{k}", {}) for k in range(n)))
    done = revert.reverted({"Group": chain}, log, references=(revert.Reference("Group", "parent", "Group"),))
    assert done.applied == n and done.tables["Group"].count() == 0


def test_the_marker_closes_the_journal(spark, tables):
    log = log_of(spark, ("delete_record", "Group", "lone", {}))
    done = revert.reverted(tables, log, run="r")
    assert journal.is_reverted(revert.whole(log).unionByName(done.marker.select("event", "reverted", "status").withColumn("seq", done.marker["reverted"] + 10), allowMissingColumns=True))
