"""Operators on small sheets whose answers are known."""

import itertools
import random
import subprocess
import sys
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.operators import corrections, dedup, journal, neardup, party, profile, quality, tree
from tabulon.plans import analysis, api, infer, matching, parties
from tabulon.queries import CUSTOMER_META, PARTY_METAS, QUERIES
from tabulon.sources import files, records, schema, store
from tabulon.streaming import logs


def sheet(spark, headers, rows):
    return spark.createDataFrame([(k + 2, *r) for k, r in enumerate(rows)], ", ".join(["__row long", *(f"`{h}` string" for h in headers)]))


DIRTY = [
    ("Alpha", "a@x"), ("Beta", "1"), ("Beta", "1"), ("Gamma", "1"), ("Gamma", "2"), ("Delta", "1"), ("delta", "1"), ("", "1"), (None, "2"), ("Eps ", "1"), ("Eps", "1"), ("Northwind Traders", "q"), ("Northwind Trader", "r"),
]


def test_clean(spark):
    rows = sheet(spark, ["Name", "Other"], DIRTY)
    groups = {r.first_row: r for r in quality.duplicate_groups(rows, "Name").collect()}
    assert sorted(groups) == [3, 5, 7, 11]
    assert groups[3].identical and groups[5].differing_fields == ["Other"] and groups[7].case_variant and groups[11].whitespace_variant
    assert groups[11]["values"] == ["Eps ", "Eps"] and groups[5].rows == [5, 6]
    missing = quality.missing_values(rows, "Name", ["Name"]).collect()
    assert [(r.header, r.role, r["count"], r.rows) for r in missing] == [("Name", "key,required", 2, [9, 10])]
    found = {r.kind: r.severity for r in analysis.clean(rows, "Name").collect()}
    assert found == {"duplicate_row": "error", "missing_value": "error", "possible_duplicate_row": "warning"}
    assert analysis.exit_code(analysis.clean(rows, "Name")) == 2
    assert analysis.clean(rows.limit(0), "Name").count() == 0


PAIRS = [
    ("Acme Steel", "a"), ("Acme Stel", "b"), ("Bolt Works", "c"), ("Blot Works", "d"), ("Cedar Mills", "e"), ("Cedar Mills Pte Ltd", "f"), ("Delta Iron Yard", "g"), ("Yard Delta Iron", "h"), ("Echo Traders", "i"), ("Foxtrot Supplies", "i"), ("Golf Club", "j"), ("Hotel Lobby", "k"),
]


def test_near_pairs(spark):
    rows = sheet(spark, ["Name", "Email"], PAIRS)
    got = [(r.a_row, r.b_row, r.signals, r.shared_fields) for r in neardup.near_duplicate_pairs(rows, "Name", ["Email"]).orderBy("a_row").collect()]
    assert got == [(2, 3, ["key_fuzzy"], []), (4, 5, ["key_fuzzy"], []), (6, 7, ["key_fuzzy", "token_reorder"], []), (8, 9, ["token_reorder"], []), (10, 11, ["shared_identifier"], ["Email"])]


@pytest.mark.parametrize("longest", [4, 16, 40])
def test_close_strings_is_complete(spark, longest):
    draw = random.Random(longest)
    base = ["".join(draw.choice("ab ") for _ in range(draw.randint(0, longest))) for _ in range(60)]

    def changed(s):
        for _ in range(draw.randint(0, 3)):
            k = draw.randint(0, len(s))
            s = draw.choice([s[:k] + s[k + 1 :], s[:k] + draw.choice("abc") + s[k:], s[:k] + "c" + s[k + 1 :]])
        return s

    strings = sorted({*base, *(changed(s) for s in base * 3)})
    frame = spark.createDataFrame([(s,) for s in strings], "s string")
    got = {(r.a, r.b, r.distance) for r in neardup.close_strings(frame, "s").collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b, d) for a, b in itertools.combinations(strings, 2) if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2}
    assert got == want


def test_profiles(spark):
    rows = sheet(spark, ["id", "rate", "flag", "when", "note", "blank"], [("1", "45.5", "Yes", "1.2.2024", "$ 5 ", " "), ("2", "120", "no", "3.4.2024", "x", ""), ("3", "1.5", "Y", "5.6.2024", "x", None)])
    got = {r.header: (r.inferred_type, r.messy) for r in profile.profile_columns(rows).collect()}
    assert got == {"id": ("int", []), "rate": ("text", []), "flag": ("bool", []), "when": ("date", []), "note": ("text", ["currency_symbol", "whitespace"]), "blank": ("int", [])}


def test_tree(spark):
    rows = [("leaf", "mid"), ("mid", "top"), ("top", "outside"), ("a", "b"), ("b", "a"), ("under", "a"), ("self", "self"), ("lone", None)]
    levels = tree.levels(sheet(spark, ["n", "p"], rows), "n", "p")
    assert {r.n: r.level for r in levels.collect()} == {"leaf": 2, "mid": 1, "top": 0, "a": None, "b": None, "under": None, "self": None, "lone": 0}
    assert [r.n for r in tree.parents_first(levels).collect()] == ["top", "lone", "mid", "leaf", "a", "b", "under", "self"]
    marked = {r.n: r.is_group for r in tree.mark_groups(sheet(spark, ["n", "p"], rows), "n", "p").collect()}
    assert marked == {"leaf": 0, "mid": 1, "top": 1, "a": 1, "b": 1, "under": 0, "self": 1, "lone": 0}


def test_long_chain(spark):
    rows = [(str(k), str(k - 1)) for k in range(1, 301)]
    assert {int(r.n): r.level for r in tree.levels(sheet(spark, ["n", "p"], rows), "n", "p").collect()} == {k: k - 1 for k in range(1, 301)}


def test_tree_of_names_with_several_parents(spark):
    """of a name in several rows only the first row's link counted, so a cycle or a longer way there hid the others."""
    some = random.Random(1)
    rows = [("top", ""), ("mid", "mid"), ("mid", "top"), ("low", "loop"), ("low", "mid"), ("loop", "pool"), ("pool", "loop"), ("pool", "pool"), ("far", "low"), ("far", "top"), ("end", "far"), ("hung", "loop"), ("hung", "pool")]
    for g in range(8):
        names = [f"{g}.{k}" for k in range(some.randint(1, 9))]
        rows += [(some.choice([*names, *names, ""]), some.choice([*names * 9, "", "away"])) for _ in range(2 * len(names))]
    rows += [(f"back {k:02}", f"back {k - j:02}") for k in range(1, 16) for j in (-1, 1, 2)]
    # the reference's rounds
    want, done, left, names = {}, set(), set(range(len(rows))), {n for n, _ in rows} - {""}
    for turn in itertools.count():
        ready = [k for k in left if rows[k][1] not in names - done]
        if not ready:
            break
        want |= dict.fromkeys(ready, turn)
        done |= {rows[k][0] for k in ready}
        left -= set(ready)
    assert want[4] == 2 and want[10] == 2 and {11, 12} <= left and max(want.values()) >= 5
    assert {r["__row"] - 2: r.level for r in tree.levels(sheet(spark, ["n", "p"], rows), "n", "p").collect()} == want | dict.fromkeys(left)


def test_nothing_is_free_where_keys_have_gaps(spark, tmp_path):
    """tree_cycle left out the rows whose parent isn't in the table, and those below."""
    spark.sql("select explode(array(1L, 3L, 8L, 17L, 1000000L, 1000001L)) as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(r.row_no for r in QUERIES["tree_cycle"](spark, str(tmp_path)).collect()) == [3, 5, 10, 19, 1000002, 1000003]


def test_corrections(spark):
    rows = sheet(spark, ["Name", "Code", "City"], [("A", "1", "x"), ("B", "2", "y"), ("B", "3", "z"), ("C", "4", "w")])
    fixes = [
        {"id": "a", "action": "set_value", "reason": "r", "ref": "A", "column": "City", "from": "x", "to": "q"},
        {"id": "b", "action": "set_value", "reason": "r", "ref": "A", "column": "City", "from": "x", "to": "late"},
        {"id": "c", "action": "skip_row", "reason": "r", "ref": "B"},
        {"id": "d", "action": "change_key", "reason": "r", "column": "Code"},
        {"id": "e", "action": "merge_rows", "reason": "r", "rows": ["2", "3"], "keep": "2", "values": {"City": "both"}},
        {"id": "f", "action": "skip_row", "reason": "r", "ref": 5},
    ]
    out, verdicts = corrections.prepared(rows, "Name", fixes)
    assert [tuple(r) for r in out.orderBy("__row").collect()] == [(2, "A", "1", "q"), (3, "B", "2", "both"), (5, "C", "4", "w")]
    assert {k: v["applicable"] for k, v in verdicts.items()} == {"a": True, "b": False, "c": False, "d": True, "e": True, "f": False}
    assert verdicts["f"]["invalid"]
    moved, _ = corrections.prepared(rows, "Name", [{"id": "g", "action": "skip_row", "reason": "r", "ref": {"row": 2}}], same_source=False)
    assert moved.count() == 4


def test_matching():
    mapping = matching.suggest(["Customer Name", "customer_type", "Group", "Email", "Nothing"], CUSTOMER_META)
    assert [(m.path, m.method) for m in mapping.matches[:3]] == [("customer_name", "exact"), ("customer_type", "exact"), ("customer_group", "token")]
    assert mapping.matches[4].path is None and matching.required_missing(mapping) == ["territory"]
    forced, count, warnings = matching.with_overrides(mapping, {"mappings": {"Nothing": "territory", "gone": "x"}, "defaults": {"customer_type": "Company"}})
    assert forced.matches[4].path == "territory" and count == 2 and len(warnings) == 1


def test_inference():
    assert infer.party_of(["Customer Name", "Contact Name"]) == "Customer" and infer.doctype_of(["Customer Name", "Contact Name"]) is None
    assert infer.doctype_of(["Item Code"]) == "Item" and infer.doctype_of(["x"], "/a/Customer_groups_1.csv") == "Customer Group"


def test_import(spark):
    rows = sheet(spark, ["Customer Name", "Group", "Territory"], [("A", "Retail", "North"), ("B", "Nope", "North"), ("A", "Retail", "North")])
    linked = {"Customer Group": spark.createDataFrame([("Retail", 0)], "name string, is_group int"), "Territory": spark.createDataFrame([("North", 0)], "name string, is_group int")}
    target = spark.createDataFrame([("B",)], "customer_name string")
    done = api.import_sheet(rows, CUSTOMER_META, target, linked)
    assert done.blocked and {r.conflict_key.split(":")[0] for r in done.conflicts.filter("severity = 'error'").collect()} == {"link_value_conflict"}
    assert [(r.key, r.status) for r in done.statuses.orderBy("__row").collect()] == [("A", "create"), ("B", "skipped"), ("A", "skipped")]
    fixed = api.import_sheet(rows, CUSTOMER_META, target, linked, fixes=[{"id": "1", "action": "dismiss_conflict", "reason": "r", "conflict": "link_value_conflict:Group"}])
    assert not fixed.blocked


def test_parties(spark):
    heads = ["Customer Name", "Contact Name", "Email", "Address Line 1"]
    rows = sheet(spark, heads, [("P", "Ann Lee", "a@x", "Road"), ("P", "Ann Lee", "a@x", "Road"), ("Q", "", "a@x", ""), (None, "Bo", "b@x", "R")])
    none = spark.createDataFrame([], "key string")
    got = {(r.entity, r.status): r["count"] for r in api.import_parties(rows, none, none, none).collect()}
    assert got == {("party", "created"): 2, ("party", "skipped"): 1, ("party", "failed"): 1, ("contact", "created"): 1, ("contact", "linked"): 2, ("address", "created"): 1, ("address", "linked"): 1}
    assert party.new_links(rows, party.PARTIES["Customer"]).count() == 2


def test_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_bytes('﻿Name ;Note;Name\nA;"two\nlines";x\n;;\nName ;Note;Name\nB\n'.encode())
    rows = files.read_source(spark, str(path)).orderBy("__row").collect()
    assert [(r["__row"], r["Name"], r["Note"]) for r in rows] == [(2, "A", "two\nlines"), (3, "Name ", "Note"), (4, "B", None)]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        files.read_source(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ValueError):
        files.read_source(spark, "x.ods")


def test_xlsx(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si><si><t>Day</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3"><v>5.0</v></c><c r="C3" s="1"><v>45352</v></c></row></sheetData></worksheet>')
    rows = files.read_source(spark, str(tmp_path / "b.xlsx")).collect()
    assert [(r["__row"], r["Name"], r["Day"]) for r in rows] == [(2, "5", "2024-03-01 00:00:00")]


def test_records(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    assert records.list_records(table, [("name", "like", "%A%")]).collect()[0].name == "a"
    with pytest.raises(ValueError):
        records.condition([("n", ">", 1)])
    with pytest.raises(LookupError):
        records.get_record(table, "name", "zz")
    assert records.set_docstatus(table.withColumn("docstatus", F.lit(0)), table.filter("n = 1"), "name", 2).filter("docstatus = 2").count() == 1


def test_store(tmp_path):
    path = tmp_path / "m.json"
    assert store.set_mapping(path, "Customer", "Col", "field") is None and store.set_mapping(path, "Customer", "Col", None) == "field"
    assert store.unset_mapping(path, "Customer", "Col") and not store.unset_mapping(path, "Customer", "Col")
    path.write_text("{\n x")
    with pytest.raises(ValueError, match="line 2"):
        store.load(path)
    for k in range(12):
        store.save_analysis(tmp_path / "a", "s", f"{k:02}", {"k": k}, keep=10)
    assert len(list((tmp_path / "a").glob("s-*.json"))) == 10


def test_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"status": "created"}\nbroken {\n{"status": "failed"}\n{"status": "created"}\n')
    read = journal.read_log(spark, str(tmp_path / "in"), "status string")
    assert {r.status: r["count"] for r in journal.log_counts(read).collect()} == {"created": 2, "failed": 1}
    logs.running_counts(logs.follow(spark, str(tmp_path / "in"), "status string"), "counted", str(tmp_path / "c")).awaitTermination(60)
    assert {r.status: r["count"] for r in spark.table("counted").collect()} == {"created": 2, "failed": 1}


def test_same_for_any_partitions(spark):
    rows = sheet(spark, ["Name", "Email"], PAIRS)
    seen = set()
    for n in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(str(sorted(map(str, neardup.near_duplicate_pairs(rows.repartition(n), "Name", ["Email"]).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(seen) == 1


def test_intermediate_tables_go_with_the_session(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from tabulon.sources.shared import new_folder, removed, stored, written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
path = new_folder(spark, "a")
assert stored(spark.range(3), path).count() == 3
removed(spark, path)
assert written(spark.range(5), "b").count() == 5
from pathlib import Path
assert len(list(Path({str(tmp_path)!r}).glob("tabulon-*/*"))) == 1
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=Path(__file__).parent.parent)
    for _ in range(100):
        if not list(tmp_path.glob("tabulon-*")):
            break
        time.sleep(0.1)
    assert not list(tmp_path.glob("tabulon-*"))


def test_numbered_over_many_partitions(spark):
    rows = spark.range(0, 200_000, numPartitions=16).select((F.col("id") * 7919 % 200_003).alias("k"))
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        out = dedup.numbered(rows, "k")
        rank = F.row_number().over(Window.orderBy("k")) + 1
        assert out.withColumn("want", rank).filter("want <> __row").count() == 0 and out.count() == 200_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("crowd", [200, 40])
def test_a_common_prefix_is_no_nested_loop(spark, crowd):
    draw = random.Random(crowd)
    names = [f"Customer number {draw.randrange(16**12):012x}" for _ in range(crowd)]
    names += [n[:20] + "z" + n[21:] for n in names[:10]] + [n + "q" for n in names[10:20]] + [n[:3] + n[4:] for n in names[20:30]] + ["A" + n[1:-1] for n in names[30:35]]
    frame = spark.createDataFrame([(n,) for n in names], "s string")
    got = {(r.a, r.b) for r in neardup.close_strings(frame, "s").collect()}
    assert got == {tuple(sorted(p)) for p in itertools.combinations(set(names), 2) if plain_distance(*p) <= 2} and len(got) >= 35
    ids = frame.select(F.md5("s").alias("id"), "s")
    if crowd > neardup.CROWDED * 2:
        assert neardup._met_by_pieces(ids, 2).distinct().count() < 50 * crowd


def plain_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_pair_count_is_the_number_of_pairs(spark):
    draw = random.Random(5)
    words = ["Acme", "Acne", "Bolt", "Steel Works", "steel works", "Works Steel", "Ltd", "Trader", "Traders", "Iron Yard Delta", "Delta Iron Yard"]
    rows = [(" ".join(draw.sample(words, draw.randint(1, 2))), draw.choice("abcdefgh")) for _ in range(120)]
    frame = sheet(spark, ["Name", "Email"], rows)
    assert neardup.pair_count(frame, "Name", ["Email"]).first().n == neardup.near_duplicate_pairs(frame, "Name", ["Email"]).count() > 0
    assert neardup.pair_count(frame.limit(0), "Name", []).first().n == 0


def test_flat_sheet(spark):
    spec, metas = party.PARTIES["Customer"], PARTY_METAS
    names = ["Customer Name", "Group", "Contact Name", "Email", "Address Line 1", "Postal Code", "Country", "Vip"]
    rows = sheet(spark, names, [("Ann", "Retail", "A B", "a@x", "Road 1", "01234", "Chad", "Yes"), ("Bob", "None", "", "", "", "", "Peru", "no"), ("", "Other", "", "", "", "", "Peru", "")])
    linked = {"Customer Group": spark.createDataFrame([("Retail", 1)], "name string, is_group int"), "Country": spark.createDataFrame([("Chad",)], "name string")}
    found = {(r.kind, r.source): (r.severity, r.target, r.detail) for r in parties.analyse(rows, spec, metas, linked).collect()}
    assert found[("unmapped_column", "Vip")] == ("error", "customer.is_vip", "extend customer.is_vip")
    assert found[("link_value_conflict", "Group")][2] == "None" and found[("link_group_node", "Group")][2] == "Retail"  # not Other: its row has no party
    assert found[("link_value_conflict", "Country")][1:] == ("address.country", "Peru") and ("missing_value", "Customer Name") in found
    done = api.import_party_sheet(rows, metas, linked, {"Vip": "customer.is_vip"})
    assert done.blocked and [r.is_vip for r in done.parties.orderBy("__row").collect()] == ["1", "0", None]
    assert [r.pincode for r in done.addresses.orderBy("__row").collect()] == ["01234", None, None]
    assert party.flat_target("Customer . tax_id") == ("customer", "tax_id") and party.flat_target("invoice.x") is None and party.flat_target("customer.") is None


def test_verbs_and_revert(spark, tmp_path):
    people = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "name string, age int, city string")
    new, made = api.create_record(people, spark.createDataFrame([("c", 3, "z"), ("a", 9, "q")], "name string, age int, city string"), "name", "Person")
    changed, written = api.update_record(new, spark.createDataFrame([("b", 5)], "name string, age int"), "name", "Person")
    again, more = api.update_record(changed, spark.createDataFrame([("b", 6)], "name string, age int"), "name", "Person")
    assert {(r.name, r.age) for r in again.collect()} == {("a", 1), ("b", 6), ("c", 3)}
    none = F.lit(None).cast("string")
    log = None
    for k, e in enumerate((made, written, more)):
        e = e.withColumns({"seq": F.lit(k), "link_doctype": none, "link_name": none})
        log = e if log is None else log.unionByName(e)
    back = api.revert({"Person": again}, log)["Person"]
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in people.collect()}
    assert {tuple(r) for r in api.revert({"Person": back}, log)["Person"].collect()} == {tuple(r) for r in people.collect()}
    last = journal.marker(log, "r1").withColumns({"seq": F.lit(9)})
    assert not journal.is_reverted(log.withColumns({"status": none, "reverted": F.lit(None).cast("long")}))
    assert journal.is_reverted(log.withColumns({"status": none, "reverted": F.lit(None).cast("long")}).unionByName(last, allowMissingColumns=True))
    journal.append_log(last, str(tmp_path / "log"))
    journal.append_log(last, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert api.delete_record(people, people.filter("name = 'a'"), "name").count() == 1
    meta, entry = api.create_field(CUSTOMER_META, "Loyalty Tier!")
    assert meta.field("loyalty_tier") and entry["name"] == "Customer-loyalty_tier" and api.create_field(meta, "Loyalty Tier")[1] == {}
    path = tmp_path / "o.json"
    assert api.set_mapping(path, "Customer", "Vip", "tax_id")["fields"] == {"previous": None}
    entry = api.set_mapping(path, "Customer", "Vip", None)
    fixes, said = api.correct([], {"action": "skip_row", "reason": "r", "ref": "a"})
    assert api.correct(fixes, {"action": "skip_row", "reason": "r", "ref": "a"})[1] == {}
    schema = "seq int, event string, op string, doctype string, name string, fields map<string,string>"
    undo = spark.createDataFrame([(1, "effect", entry["op"], "Customer", "Vip", entry["fields"]), (2, "effect", said["op"], None, said["name"], None)], schema)
    settings, left = journal.settings_undone(store.load(path), fixes, undo, "2024")
    assert settings["Customer"]["mappings"] == {"Vip": "tax_id"} and corrections.active(left) == [] and len(left) == 1


def test_import_marks_groups_and_reads_numbers(spark):
    meta = schema.TableMeta("Territory", (schema.FieldMeta("territory_name", "Territory Name", required=True), schema.FieldMeta("parent", "Parent", "Link", options="Territory"), schema.FieldMeta("is_group", "Is Group", "Check"), schema.FieldMeta("size", "Size", "Int")))
    rows = spark.createDataFrame([(2, "leaf", "mid", "", 12.5), (3, "mid", "top", None, -3.9), (4, "top", "", "yes", None), (5, "solo", "", "No", 1.0)], "__row long, `Territory Name` string, Parent string, `Is Group` string, Size double")
    none = spark.createDataFrame([], "territory_name string")
    done = api.import_sheet(rows, meta, none, {}, id_field="territory_name")
    assert [(r.territory_name, r.is_group, r["size"]) for r in done.create.collect()] == [("top", 1, None), ("solo", 0, 1), ("mid", 1, -3), ("leaf", 0, 12)]
