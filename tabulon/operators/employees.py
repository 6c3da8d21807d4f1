"""Employee rules: generated numbers, department names, reporting managers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import blank, strip
from tabulon.operators.profile import ROW, headers

# Normalised headers of the employee's number, full name and own fields.
ID_HEADERS = frozenset({
    "empid", "employeeid", "empno", "employeeno", "employeenumber", "staffid", "staffno", "staffnumber", "empcode", "employeecode", "personnelnumber",
    "badgeid", "badgeno", "badgenumber",
})
NAME_HEADERS = frozenset({"fullname", "employeename"})
OWN_FIELDS = {"bankbranch": ("bank_branch", "Bank Branch", "Data")}
ID_FIELD = "employee_number"
DEPARTMENT_HEADERS = frozenset({"department", "dept"})
COMPANY_HEADERS = frozenset({"company"})


def numbering(rows: DataFrame, field: str = ID_FIELD) -> tuple[str, int, int]:
    """(prefix, width, highest number) of the sheet's own ids; EMP-, 3, 0 if it has none."""
    prefix, digits = F.regexp_extract(field, r"^(.*?)(\d+)$", 1), F.regexp_extract(field, r"^(.*?)(\d+)$", 2)
    found = rows.filter(strip(F.col(field)).rlike(r"^.*?\d+$")).select(ROW, prefix.alias("p"), digits.alias("d"))
    first = found.agg(F.min_by("p", ROW).alias("p")).first()
    if first is None or first["p"] is None:
        return "EMP-", 3, 0
    own = found.filter(F.col("p") == first["p"]).agg(F.max(F.length("d")).alias("w"), F.max(F.col("d").try_cast("long")).alias("n")).first()
    return first["p"], own["w"], own["n"] or 0


def generate_ids(rows: DataFrame, field: str = ID_FIELD) -> DataFrame:
    """rows with missing ids made: the sheet's prefix, then numbers after its highest, in row order."""
    prefix, width, highest = numbering(rows, field)
    place = _places(rows.filter(blank(field)).select(ROW))
    number = (F.col("__place") + highest).cast("string")
    made = F.concat(F.lit(prefix), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number))
    joined = rows.join(place, ROW, "left")
    return joined.withColumn(field, F.when(F.col("__place").isNotNull(), made).otherwise(F.col(field))).select(*rows.columns)


def _places(rows: DataFrame, part: int = 65_536) -> DataFrame:
    """__row, __place (1, 2, ... in row order): ranks within runs of rows, plus the rows of earlier runs."""
    rows = rows.withColumn("__run", F.floor(F.col(ROW) / part))
    runs = rows.groupBy("__run").agg(F.count("*").alias("__n"))
    before = runs.select("__run", F.coalesce(F.sum("__n").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__run").orderBy(ROW))
    return rows.withColumn("__k", rank).join(before, "__run").select(ROW, (F.col("__k") + F.col("__before")).alias("__place"))


def department_map(sheet: DataFrame, department: str, company: str, existing: DataFrame, abbreviation: str) -> DataFrame:
    """value, target of each department: a name that exists stays, else '<value> - <abbreviation>'.

    Only for a sheet with exactly one company; else no row.
    """
    one = sheet.filter(~blank(F.col(f"`{company}`"))).agg((F.min(strip(F.col(f"`{company}`"))) == F.max(strip(F.col(f"`{company}`")))).alias("one"))
    values = sheet.select(strip(F.col(f"`{department}`")).alias("value")).filter("value <> ''").distinct()
    named = values.join(existing.select(F.col("name").alias("value"), F.lit(True).alias("there")).distinct(), "value", "left")
    out = named.select("value", F.when(F.col("there"), F.col("value")).otherwise(F.concat("value", F.lit(f" - {abbreviation}"))).alias("target"))
    return out.join(F.broadcast(one.filter("one")), how="cross").select("value", "target")


def column_named(sheet: DataFrame, names: frozenset[str]) -> str | None:
    """The first column whose normalised header is one of names."""
    return next((h for h in headers(sheet) if re.sub("[^a-z0-9]+", "", h.lower()) in names), None)


def departments(sheet: DataFrame, existing: DataFrame, companies: DataFrame) -> DataFrame | None:
    """value, target, made, company of an employee sheet's departments; None for a sheet without one.

    existing: name, department_name. A department that exists under that name keeps its record's, also one made by hand;
    else it is made as '<value> - <abbreviation of the company>'. No rows without exactly one company, or if that has no abbreviation.
    """
    department, company = column_named(sheet, DEPARTMENT_HEADERS), column_named(sheet, COMPANY_HEADERS)
    if department is None or company is None:
        return None
    text = lambda h: strip(F.col(f"`{h}`"))
    one = sheet.filter(~blank(F.col(f"`{company}`"))).agg(F.min(text(company)).alias("company"), F.max(text(company)).alias("last")).filter("company = last").select("company")
    own = one.join(companies.select(F.col("name").alias("company"), "abbr"), "company").filter("abbr <> ''").limit(1)
    known = existing.filter("department_name <> ''").groupBy(F.col("department_name").alias("value")).agg(F.max("name").alias("there"))
    values = sheet.select(text(department).alias("value")).filter("value <> ''").distinct().join(known, "value", "left")
    rows = values.join(F.broadcast(own), how="cross")  # one row at most
    return rows.select("value", F.coalesce("there", F.concat("value", F.lit(" - "), "abbr")).alias("target"), F.col("there").isNull().alias("made"), "company")


def in_departments(payloads: DataFrame, known: DataFrame, field: str = "department") -> DataFrame:
    """payloads with department names in place of the sheet's values."""
    joined = payloads.join(known.select(F.col("value").alias("__value"), F.col("target").alias("__target")), F.col(field) == F.col("__value"), "left")
    return joined.withColumn(field, F.coalesce("__target", field)).select(*payloads.columns)


def manager_links(sheet: DataFrame, number: str, name: str, manager: str, site: DataFrame) -> DataFrame:
    """__row, own, manager_number, status of rows that name a manager.

    site: name, employee_number, reports_to of the target's employees. A manager is found by full name (the first row
    of a name counts), else by number. Status: unknown (no such manager), self, absent (either is not on the
    site), already (nothing to do) or update.
    """
    text = lambda h: strip(F.col(f"`{h}`"))
    rows = sheet.select(ROW, text(number).alias("own"), text(name).alias("name"), text(manager).alias("manager"))
    by_name = rows.filter("name <> '' and own <> ''").groupBy("name").agg(F.min_by("own", ROW).alias("by_name")).withColumnRenamed("name", "manager")
    numbers = rows.filter("own <> ''").select(F.col("own").alias("manager"), F.col("own").alias("by_number")).distinct()
    asked = rows.filter("own <> '' and manager <> ''").join(by_name, "manager", "left").join(numbers, "manager", "left")
    asked = asked.select(ROW, "own", F.coalesce("by_name", "by_number").alias("manager_number"))
    known = site.select(F.col("employee_number").cast("string").alias("number"), F.col("name").alias("doc"), F.col("reports_to").alias("up"))
    known = known.filter("number is not null and number <> ''")
    both = asked.join(known.select(F.col("number").alias("own"), F.col("doc").alias("own_doc"), F.col("up").alias("own_up")), "own", "left")
    both = both.join(known.select(F.col("number").alias("manager_number"), F.col("doc").alias("manager_doc")), "manager_number", "left")
    return both.select(ROW, "own", "manager_number", _manager_status().alias("status"))


def _manager_status() -> Column:
    return (
        F.when(F.col("manager_number").isNull(), "unknown").when(F.col("manager_number") == F.col("own"), "self")
        .when(F.col("own_doc").isNull() | F.col("manager_doc").isNull(), "absent")
        .when(F.col("own_up") == F.col("manager_doc"), "already").otherwise("update")
    )
