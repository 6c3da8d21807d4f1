"""Case folding, ids and departments of the import verb, parties as tables, workbooks of a folder."""

import zipfile

from pyspark.sql import functions as F

from tabulon.functions import text
from tabulon.operators import party, revert, transform
from tabulon.plans import api
from tabulon.sources import files, schema


def sheet(spark, columns, rows):
    return spark.createDataFrame([(k + 2, *r) for k, r in enumerate(rows)], ", ".join(["__row long", *(f"`{c}` string" for c in columns)]))


def test_full_case_folding(spark):
    words = ["Straße", "STRASSE", "ﬁsh ﬂow", "ΟΔΟΣ", "οδος", "ŉ", "ΐΰ", "İstanbul", "ẞ", "ſ µ", "և", "plain", "", None, "Ǆ ǅ", "ᾳ ᾼ"] + ["".join(map(chr, range(a, a + 256))) for a in (0, 256, 512, 768, 1024, 7680, 7936, 64256)]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string")
    got = {r["k"]: r["f"] for r in df.select("k", text.casefold("w").alias("f")).collect()}
    assert got == {k: (w or "").casefold() for k, w in enumerate(words)}


def test_ids_from_a_column(spark):
    rows = sheet(spark, ["Title", "Code"], [("a", " X1\t"), ("b", " "), ("c", None)])
    payloads = rows.select("__row", F.col("Title").alias("title"))
    assert [r["name"] for r in transform.inject_id(payloads, rows, "Code", "name").orderBy("__row").collect()] == ["X1", None, None]
    meta = schema.TableMeta("Task", (schema.FieldMeta("title", "Title"),), (), "hash")
    done = api.import_sheet(rows, meta, spark.createDataFrame([], "name string"), {}, key="Title", id_column="Code")
    assert {r["title"]: (r["name"], r["status"]) for r in done.statuses.collect()} == {"a": ("X1", "create"), "b": (None, "failed"), "c": (None, "failed")}


EMPLOYEE = schema.TableMeta("Employee", (
    schema.FieldMeta("employee_number", "Employee Number"), schema.FieldMeta("first_name", "First Name", required=True), schema.FieldMeta("department", "Department", "Link", options="Department"), schema.FieldMeta("company", "Company", "Link", options="Company"),
))


def test_departments_get_their_records_names(spark):
    rows = sheet(spark, ["Emp ID", "Full Name", "Dept", "Company"], [("1", "Ann", "Sales", "Acme"), ("", "Bo", " Lab ", "Acme"), ("3", "Cy", "", "Acme"), ("4", "Di", "Old", "Acme")])
    there = spark.createDataFrame([("Sales - HQ", "Sales"), ("Old", None)], "name string, department_name string")
    companies = spark.createDataFrame([("Acme", "AC"), ("Other", "OT")], "name string, abbr string")
    linked = {"Department": there, "Company": companies.select("name")}
    none = spark.createDataFrame([], "employee_number string")
    done = api.import_sheet(rows, EMPLOYEE, none, linked, overrides={"mappings": {"Dept": "department", "Company": "company"}}, companies=companies)
    assert {r["first_name"]: r["department"] for r in done.create.collect()} == {"Ann": "Sales - HQ", "Bo": "Lab - AC", "Cy": None, "Di": "Old - AC"}
    assert sorted((r["value"], r["target"], r["made"], r["company"]) for r in done.departments.collect()) == [("Lab", "Lab - AC", True, "Acme"), ("Old", "Old - AC", True, "Acme"), ("Sales", "Sales - HQ", False, "Acme")]
    assert done.conflicts.filter("conflict_key like 'link_value_conflict:Dept%'").count() == 0
    two = sheet(spark, ["Emp ID", "Full Name", "Dept", "Company"], [("1", "Ann", "Sales", "Acme"), ("2", "Bo", "Lab", "Other")])
    left = api.import_sheet(two, EMPLOYEE, none, linked, overrides={"mappings": {"Dept": "department", "Company": "company"}}, companies=companies)
    assert left.departments.count() == 0 and {r["department"] for r in left.create.collect()} == {"Sales", "Lab"}


def test_parties_as_tables_and_back(spark):
    heads = ["Customer Name", "Contact Name", "Email", "Address Line 1"]
    rows = sheet(spark, heads, [("P", "Ann Lee", "a@x", "Road"), ("Q", "Ann Lee", "a@x", ""), (None, "Bo", "b@x", "R"), ("R", "Cy", "c@x", "Lane"), ("R", "Cy", "c@x", "Lane")])
    link = lambda n: {"link_doctype": "Customer", "link_name": n}
    contacts = spark.createDataFrame([("c@x", [link("Old"), link("R")]), ("z@x", [])], "key string, links array<struct<link_doctype: string, link_name: string>>")
    target = {"party": spark.createDataFrame([("Q",)], "key string"), "contact": contacts, "address": spark.createDataFrame([], "key string")}
    done, entries = api.upsert_parties(rows, target)
    assert [(r["__row"], r["key"], r["status"]) for r in done.parties.orderBy("__row").collect()] == [(2, "P", "created"), (3, "Q", "skipped"), (4, "", "failed"), (5, "R", "created"), (6, "R", "skipped")]
    assert [(r["__row"], r["status"]) for r in done.contacts.orderBy("__row").collect()] == [(2, "created"), (3, "linked"), (5, "linked"), (6, "linked")]
    assert {r["key"]: [x["link_name"] for x in r["links"]] for r in done.contact_links.collect()} == {"a@x": ["P", "Q"], "c@x": ["Old", "R"]}
    assert {r["key"]: [x["link_name"] for x in r["links"]] for r in done.address_links.collect()}.keys() and sorted(r["links"][0]["link_name"] for r in done.address_links.collect()) == ["P", "R"]
    counts = {(r.entity, r.status): r["count"] for r in party.upsert_counts(rows, party.PARTIES["Customer"], target["party"], contacts.select("key"), target["address"]).collect()}
    assert counts == {("party", "created"): 2, ("party", "skipped"): 2, ("party", "failed"): 1, ("contact", "created"): 1, ("contact", "linked"): 3, ("address", "created"): 2, ("address", "linked"): 1}
    log = entries.withColumn("seq", F.monotonically_increasing_id())
    made = {"Contact": done.contact_links.withColumnRenamed("key", "name"), "Customer": spark.createDataFrame([("P",), ("Q",), ("R",)], "name string"), "Address": spark.createDataFrame([], "name string")}
    back = revert.reverted(made, log)
    assert {r["name"] for r in back.tables["Customer"].collect()} == {"Q"} and [[x["link_name"] for x in r["links"]] for r in back.tables["Contact"].filter("name = 'c@x'").collect()] == [["Old", "R"]]
    assert back.results.filter("not ok").count() == 0 and back.total == 6 and [r[0] for r in back.tables["Contact"].select("name").collect()] == ["c@x"]


def workbook(path, rows):
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        cells = "".join(f"<row>{''.join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in row)}</row>" for row in rows)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")


def test_workbooks_of_a_folder(spark, tmp_path):
    folder = tmp_path / "all.xlsx"
    folder.mkdir()
    workbook(folder / "b.xlsx", [["Name", "N"], *([f"b{k}", str(k)] for k in range(30))])
    workbook(folder / "a.xlsx", [["Name", "N"], ["a0", "0"], ["a1"]])
    got = [tuple(r) for r in files.read_source(spark, str(folder)).orderBy("__row").collect()]
    assert got == [(2, "a0", "0"), (3, "a1", ""), *((4 + k, f"b{k}", str(k)) for k in range(30))]
