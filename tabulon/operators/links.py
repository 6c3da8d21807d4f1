"""References: values that a linked table lacks, or that name a group where a leaf is needed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import blank, strip
from tabulon.operators.profile import ROW
from tabulon.operators.quality import distinct_in_order

#: (target table, field) whose values must be leaves of the linked tree.
LEAF_ONLY = frozenset({("Customer", "customer_group")})


def mapped(c: Column, value_map: dict[str, str] | None) -> Column:
    """The recorded replacement of a value, else the value."""
    if not value_map:
        return c
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in value_map.items() for x in pair)), c), c)


def missing_links(sheet: DataFrame, header: str, linked: DataFrame | None, name: str, value_map: dict[str, str] | None = None, own: str | None = None) -> DataFrame:
    """value, first_row of values that linked[name] lacks; own: a column of the sheet that provides names, too.

    linked None is a lookup that failed: nothing can be said, so nothing is missing.
    """
    values = distinct_in_order(sheet, header)
    if linked is None:
        return values.limit(0)
    values = values.withColumn("value", mapped(F.col("value"), value_map)).groupBy("value").agg(F.min("first_row").alias("first_row"))
    names = linked.select(F.col(name).cast("string").alias("value"))
    if own:
        names = names.union(sheet.select(strip(F.col(f"`{own}`"))))
    return values.join(names.distinct(), "value", "left_anti")


def group_nodes(sheet: DataFrame, header: str, linked: DataFrame, name: str, is_group: str, value_map: dict[str, str] | None = None) -> DataFrame:
    """value, first_row of values that are groups in linked."""
    values = distinct_in_order(sheet, header).withColumn("value", mapped(F.col("value"), value_map))
    groups = linked.filter(F.col(is_group).cast("int") == 1).select(F.col(name).cast("string").alias("value"))
    return values.groupBy("value").agg(F.min("first_row").alias("first_row")).join(groups.distinct(), "value", "left_semi")


def listed(values: DataFrame, cap: int = 50) -> DataFrame:
    """count, values (the first `cap` in order) of a column `value`; no row without values."""
    counted = values.agg(F.lit(1).alias("one"), F.count("*").alias("count")).filter("count > 0")
    first = values.select("value").orderBy("value").limit(cap).agg(F.lit(1).alias("one"), F.array_sort(F.collect_list("value")).alias("values"))
    return counted.join(first, "one").drop("one")


@dataclass(frozen=True)
class LinkColumn:
    """A column that names records of a table. target: the fields it feeds; leaf: those of them that need a leaf of the
    table's tree; own: a column of the sheet that makes records of that table, too."""

    header: str
    table: str
    target: str = ""
    leaf: str = ""
    value_map: dict[str, str] | None = None
    own: str | None = None


def link_problems(sheet: DataFrame, columns: list[LinkColumn], linked: dict[str, DataFrame], cap: int = 50) -> DataFrame:
    """kind (link_value_conflict or link_group_node), header, target, count, values (the first `cap`) of all link columns.

    The sheet is scanned once: its cells are stacked as (table, value), reduced to one row for each with the first row of
    every column, and met once by the stacked names of all tables. Tables that linked lacks couldn't be read; nothing is
    said of their columns.
    """
    columns = [c for c in columns if c.table in linked]
    if not columns:
        return sheet.sparkSession.createDataFrame([], "kind string, header string, target string, count long, values array<string>")
    cell = lambda k, table, value: F.struct(F.lit(k).alias("k"), F.lit(table).alias("table"), value.alias("value"))
    cells = [cell(k, c.table, mapped(strip(F.col(f"`{c.header}`")), c.value_map)) for k, c in enumerate(columns)]
    cells += [cell(-1, table, strip(F.col(f"`{own}`"))) for table, own in {(c.table, c.own) for c in columns if c.own}]
    stacked = sheet.select(ROW, F.explode(F.array(*cells)).alias("c")).select(ROW, "c.k", "c.table", "c.value").filter("value <> ''")
    firsts = [F.min(F.when(F.col("k") == k, F.col(ROW))).alias(f"r{k}") for k in range(len(columns))]
    facts = stacked.groupBy("table", "value").agg(F.max(F.col("k") == -1).alias("own"), *firsts)
    names = None
    for table in dict.fromkeys(c.table for c in columns):
        df = linked[table]
        group = F.coalesce(F.col("is_group").cast("int"), F.lit(0)) if "is_group" in df.columns else F.lit(0)
        one = df.select(F.lit(table).alias("table"), F.col("name").cast("string").alias("value"), group.alias("is_group"))
        names = one if names is None else names.union(one)
    met = facts.join(names.groupBy("table", "value").agg(F.max(F.when(F.col("is_group") == 1, 1).otherwise(0)).alias("is_group")), ["table", "value"], "left")
    held = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("row")) for k in range(len(columns)))))
    leaves = F.array(*(F.lit(bool(c.leaf)) for c in columns))
    kind = F.when(F.col("is_group").isNull() & ~F.col("own"), "link_value_conflict").when((F.col("is_group") == 1) & leaves[F.col("k")], "link_group_node")
    found = met.select("value", "own", "is_group", held.alias("h")).filter("h.row is not null").select(F.col("h.k").alias("k"), "value", "own", "is_group").withColumn("kind", kind).filter("kind is not null").select("kind", "k", "value")
    place = F.row_number().over(Window.partitionBy("kind", "k").orderBy("value"))
    first = found.withColumn("place", place).filter(F.col("place") <= cap).groupBy("kind", "k").agg(F.array_sort(F.collect_list("value")).alias("values"))
    counted = found.groupBy("kind", "k").agg(F.count("*").alias("count")).join(first, ["kind", "k"])
    texts = lambda name: F.array(*(F.lit(getattr(c, name)) for c in columns))[F.col("k")]
    return counted.select("kind", texts("header").alias("header"), F.when(F.col("kind") == "link_group_node", texts("leaf")).otherwise(texts("target")).alias("target"), "count", "values")


def missing_by_target(sheet: DataFrame, columns: list[tuple[str, str]], linked: dict[str, DataFrame], importable: Column | None = None) -> DataFrame:
    """header, target, count, values (the first 50) for (header, target table) columns; linked holds a column `name` for each table.

    A target that linked lacks couldn't be read; nothing is said of it.
    """
    rows = sheet if importable is None else sheet.filter(importable)
    return link_problems(rows, [LinkColumn(header, target, target) for header, target in columns], linked).filter("kind = 'link_value_conflict'").drop("kind")


def merge_links(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, links: those of existing first, then new (link_doctype, link_name) pairs that were absent."""
    fresh = new.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("link_doctype", "link_name"))).alias("__new"))
    both = existing.join(fresh, key, "full_outer")
    none = F.array().cast("array<struct<link_doctype:string,link_name:string>>")
    return both.select(key, F.array_union(F.coalesce("links", none), F.coalesce("__new", none)).alias("links"))


def remove_link(records: DataFrame, doctype: str, name: str) -> DataFrame:
    """records without one link; the others keep their order."""
    return records.withColumn("links", F.filter("links", lambda x: ~((x["link_doctype"] == doctype) & (x["link_name"] == name))))


def importable(key: str) -> Column:
    return ~blank(F.col(f"`{key}`"))


__all__ = ["LEAF_ONLY", "ROW", "LinkColumn", "group_nodes", "importable", "link_problems", "listed", "mapped", "merge_links", "missing_by_target", "missing_links", "remove_link"]
