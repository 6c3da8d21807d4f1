"""Duplicate groups and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import blank, casefold, duplicate_key, filled, strip
from tabulon.operators.profile import ROW, headers, stacked
from tabulon.sources.shared import written


def distinct_in_order(sheet: DataFrame, header: str, cap: int | None = None, require: str | None = None) -> DataFrame:
    """value, first_row: distinct non-blank values by first appearance; require: a column that must be filled, too."""
    rows = sheet.filter(~blank(F.col(f"`{header}`")))
    if require:
        rows = rows.filter(~blank(F.col(f"`{require}`")))
    found = rows.groupBy(strip(F.col(f"`{header}`")).alias("value")).agg(F.min(ROW).alias("first_row"))
    return found.orderBy("first_row", "value").limit(cap) if cap else found


def _compared(sheet: DataFrame, key: str, compare: list[str] | None) -> list[str]:
    return [h for h in (compare if compare is not None else headers(sheet)) if h != key and h in sheet.columns]


def _hashed(sheet: DataFrame, key: str, others: list[str]) -> DataFrame:
    """__row, hashes of the folded key, the stripped cell and the cell, and the other cells, of rows whose key is not blank."""
    cell = filled(F.col(f"`{key}`"))
    rows = sheet.filter(~blank(cell)).select(F.col(ROW), cell.alias("__cell"), strip(cell).alias("__bare"), *(strip(F.col(f"`{h}`")).alias(f"__c{k}") for k, h in enumerate(others)))
    spaced = F.octet_length("__cell") != F.octet_length("__bare")
    hashes = F.md5(casefold("__bare")).alias("__key"), F.md5("__bare").alias("__text"), F.md5("__cell").alias("__t")
    return rows.select(ROW, *hashes, spaced.alias("__spaced"), *(f"__c{k}" for k in range(len(others))))


def _facts(rows: DataFrame, others: list[str]) -> DataFrame:
    """__key, first_row, count, identical, case_variant, whitespace_variant, differing_fields of each key that several rows hold."""
    differs = [F.when(F.min(f"__c{k}") != F.max(f"__c{k}"), h) for k, h in enumerate(others)]
    names = F.array_compact(F.array(*differs)) if others else F.array().cast("array<string>")
    found = rows.groupBy("__key").agg(
        F.count("*").alias("count"), F.min(ROW).alias("first_row"), (F.min("__text") != F.max("__text")).alias("case_variant"),
        F.bool_or("__spaced").alias("whitespace_variant"), names.alias("differing_fields"),
    ).filter("count > 1")
    return found.withColumn("identical", F.size("differing_fields") == 0)


def group_facts(sheet: DataFrame, key: str, compare: list[str] | None = None) -> DataFrame:
    """The columns of duplicate_groups but key_value, values and rows: what sums, bounds and distinct counts tell, without its lists."""
    others = _compared(sheet, key, compare)
    return _facts(_hashed(sheet, key, others), others).drop("__key")


def duplicate_groups(sheet: DataFrame, key: str, compare: list[str] | None = None, values: int = 25) -> DataFrame:
    """Rows that share the stripped, case-folded key: one row for each key that several rows hold.

    key_value, first_row, count, values (as read, in order, at most `values`), rows (at most `values`), identical,
    case_variant, whitespace_variant, differing_fields (against the first row, in column order).

    Facts of a group are sums, bounds and distinct counts, never a list of its rows: the lists that are shown hold
    the first `values`, taken by rank, so a key with a third of all rows is pre-aggregated like any other.
    """
    others = _compared(sheet, key, compare)
    cell = filled(F.col(f"`{key}`"))
    rows = written(_hashed(sheet, key, others), "keyed")  # keys are folded once
    facts = written(_facts(rows, others), "groups")
    members = rows.select("__key", ROW, "__t").join(facts.select("__key"), "__key", "left_semi")
    mine = Window.partitionBy("__key").orderBy(ROW)
    shown_rows = members.select("__key", ROW).withColumn("__k", F.row_number().over(mine)).filter(F.col("__k") <= values)
    shown_rows = shown_rows.groupBy("__key").agg(F.array_sort(F.collect_list(ROW)).alias("rows"))
    firsts = members.groupBy("__key", "__t").agg(F.min(ROW).alias(ROW)).withColumn("__k", F.row_number().over(mine)).filter(F.col("__k") <= values)
    firsts = firsts.select("__key", ROW).join(sheet.select(ROW, cell.alias("__cell")), ROW)
    shown = firsts.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct(ROW, "__cell"))).alias("__shown"))
    out = facts.join(shown_rows, "__key").join(shown, "__key")
    texts = F.transform("__shown", lambda x: x["__cell"])
    return out.select(duplicate_key(texts[0]).alias("key_value"), "first_row", "count", texts.alias("values"), "rows", "identical", "case_variant", "whitespace_variant", "differing_fields")


def duplicate_facts(sheet: DataFrame, key: str, compare: list[str] | None = None) -> DataFrame:
    """severity, groups: what duplicate_severity says, from the groups' facts alone; no row without groups."""
    others = _compared(sheet, key, compare)
    cell = filled(F.col(f"`{key}`"))
    rows = sheet.filter(~blank(cell)).select(F.md5(duplicate_key(cell)).alias("__key"), *(strip(F.col(f"`{h}`")).alias(f"__c{k}") for k, h in enumerate(others)))
    same = F.lit(True)
    for k in range(len(others)):
        same = same & (F.min(f"__c{k}") == F.max(f"__c{k}"))
    return duplicate_severity(rows.groupBy("__key").agg(F.count("*").alias("count"), same.alias("identical")).filter("count > 1"))


def duplicate_severity(groups: DataFrame) -> DataFrame:
    """severity, groups: an error if any group differs, else a warning; no row without groups."""
    worst = groups.agg(F.bool_and("identical").alias("same"), F.count("*").alias("groups")).filter("groups > 0")
    return worst.select(F.when(F.col("same"), "warning").otherwise("error").alias("severity"), "groups")


def missing_values(sheet: DataFrame, key: str | None, required: list[str], rows: int = 25) -> DataFrame:
    """header, role (key, required or key,required), count, rows (the first `rows`) of columns with blank cells."""
    roles = {h: ",".join(r for r, own in (("key", h == key), ("required", h in required)) if own) for h in headers(sheet)}
    wanted = [h for h in headers(sheet) if roles[h]]
    if not wanted:
        return sheet.sparkSession.createDataFrame([], "header string, role string, count long, rows array<long>")
    cells = stacked(sheet.select(ROW, *(f"`{h}`" for h in wanted))).filter(blank("value"))
    place = F.row_number().over(Window.partitionBy("header").orderBy(ROW))
    counts = cells.groupBy("header").agg(F.count("*").alias("count"))
    first = cells.withColumn("__k", place).filter(F.col("__k") <= rows).groupBy("header").agg(F.array_sort(F.collect_list(F.col(ROW).cast("long"))).alias("rows"))
    role = F.create_map(*(F.lit(x) for h in wanted for x in (h, roles[h])))
    return counts.join(first, "header").select("header", role[F.col("header")].alias("role"), "count", "rows")
