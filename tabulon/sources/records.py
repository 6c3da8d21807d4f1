"""Tables of the target: listing with filters, lookup, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import filled

Filter = tuple[str, str, object]


def condition(filters: list[Filter]) -> Column:
    """All of the filters (field, op, value); op: =, !=, in, like (any case). ValueError for another."""
    out = F.lit(True)
    for name, op, value in filters:
        c = F.col(name)
        if op == "=":
            out = out & (c == F.lit(value))
        elif op == "!=":
            out = out & (c != F.lit(value))
        elif op == "in":
            out = out & c.isin(*value)
        elif op == "like":
            out = out & c.cast("string").ilike(f"%{str(value).strip('%')}%")
        else:
            raise ValueError(f"no filter operator {op!r}")
    return out


def list_records(table: DataFrame, filters: list[Filter] | None = None, fields: list[str] | None = None, limit: int = 0, order_by: str | None = None) -> DataFrame:
    """Rows that pass, only the named fields (by default the name); limit 0 is all; order_by as in 'modified desc'."""
    out = table.filter(condition(filters or [])) if filters else table
    if order_by:
        name, _, way = order_by.partition(" ")
        out = out.orderBy(F.desc(name) if way.strip().lower() == "desc" else F.asc(name))
    out = out.limit(limit) if limit else out
    return out.select(*(fields or ["name"]))


def get_record(table: DataFrame, key: str, value: object) -> DataFrame:
    """The one row with that key; LookupError without it."""
    found = table.filter(F.col(key) == F.lit(value)).limit(1)
    if not found.take(1):
        raise LookupError(f"no {key} {value!r}")
    return found


def create_if_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key table lacks, the first of each key by the other columns' order."""
    return new.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def update_records(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """table with the columns of patch replaced where its key occurs; the key itself can't be written."""
    written = [c for c in patch.columns if c != key]
    given = patch.select(key, *(F.col(c).alias(f"__{c}") for c in written), F.lit(True).alias("__hit"))
    joined = table.join(given, key, "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in written else F.col(c) for c in table.columns))


def before_image(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """What the patch would overwrite: its columns as they are."""
    return table.join(patch.select(key), key, "left_semi").select(key, *(c for c in patch.columns if c != key))


def delete_records(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def set_docstatus(table: DataFrame, keys: DataFrame, key: str, status: int) -> DataFrame:
    """Submitted (1) or cancelled (2)."""
    return update_records(table, keys.select(key).distinct().withColumn("docstatus", F.lit(status)), key)


def load_outcome(payloads: DataFrame, key: str, existing: DataFrame, valid: Column | None = None, why: str = "not valid") -> DataFrame:
    """payload rows with ok, skipped, error: each row is judged by itself; what exists by now is skipped."""
    there = existing.select(F.col(key).alias("__k")).distinct()
    joined = payloads.join(there, F.col(key) == F.col("__k"), "left")
    good = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    skipped = F.col("__k").isNotNull()
    error = F.when(skipped, F.lit(None)).when(filled(key) == "", F.lit("no key")).when(~good, F.lit(why))
    return joined.select(*payloads.columns, (~skipped & error.isNull()).alias("ok"), skipped.alias("skipped"), error.alias("error"))
