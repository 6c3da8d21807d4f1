"""Profiles of columns: shares, samples, types and flags, in one pass for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.convert import has_currency, has_decimal_comma, is_bool, is_date, is_float, is_int
from tabulon.functions.text import blank, filled, strip

ROW = "__row"
#: Profile type to target field type.
FIELDTYPES = {"int": "Int", "float": "Float", "date": "Date", "bool": "Check", "text": "Data"}


def headers(sheet: DataFrame) -> list[str]:
    return [c for c in sheet.columns if c != ROW]


def stacked(sheet: DataFrame) -> DataFrame:
    """One row for each cell: __row, position, header, value."""
    cells = [F.struct(F.lit(k).alias("position"), F.lit(h).alias("header"), F.col(f"`{h}`").cast("string").alias("value")) for k, h in enumerate(headers(sheet))]
    return sheet.select(ROW, F.explode(F.array(*cells)).alias("c")).select(ROW, "c.*")


def profile_columns(sheet: DataFrame) -> DataFrame:
    """header, position, non_empty, unique, inferred_type, fieldtype, messy of each column.

    Distinct counts are exact, since thresholds decide on them. Cells are judged and hashed where they
    are read and grouped by (column, hash) first, so no text is shuffled and a frequent value is summed before.
    """
    value = F.col("value")
    text = ~blank(value)
    tests = {"int": is_int(value), "float": is_float(value), "bool": is_bool(value), "date": is_date(value)}
    flags = {"currency": has_currency(value), "comma": has_decimal_comma(value), "spaced": F.length(filled(value)) != F.length(strip(value))}
    cells = stacked(sheet).select("position", "header", F.md5(filled(value)).alias("value"), (filled(value) != "").alias("filled_in"), *(F.coalesce(t | ~text, F.lit(True)).alias(n) for n, t in tests.items()), *((f & text).alias(n) for n, f in flags.items()))
    every = [*(F.bool_and(n).alias(n) for n in tests), *(F.bool_or(n).alias(n) for n in flags)]
    grouped = cells.groupBy("position", "header", "value", "filled_in").agg(F.count("*").alias("n"), *every)
    facts = grouped.groupBy("position", "header").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("filled_in"), F.col("n"))), F.lit(0)).alias("filled"), F.count(F.when(F.col("filled_in"), 1)).alias("distinct"), *every
    )
    kind = F.when(F.col("int"), "int").when(F.col("float"), "float").when(F.col("bool"), "bool").when(F.col("date"), "date").otherwise("text")
    flags = F.array_compact(F.array(F.when(F.col("currency"), "currency_symbol"), F.when(F.col("comma"), "comma_as_decimal"), F.when((kind == "text") & F.col("spaced"), "whitespace")))
    target = F.create_map(*(F.lit(x) for pair in FIELDTYPES.items() for x in pair))[kind]
    return facts.select(
        "header", "position",
        (F.col("filled") / F.greatest(F.col("rows"), F.lit(1))).alias("non_empty"),
        F.when(F.col("filled") > 0, F.col("distinct") / F.col("filled")).otherwise(F.lit(0.0)).alias("unique"),
        kind.alias("inferred_type"), target.alias("fieldtype"), flags.alias("messy"),
    )


def profile_samples(sheet: DataFrame, count: int = 5) -> DataFrame:
    """header, place (from 1), value: the first distinct non-empty values of each column in row order."""
    firsts = stacked(sheet).filter(F.coalesce("value", F.lit("")) != "").groupBy("position", "header", "value").agg(F.min(ROW).alias(ROW))
    place = F.row_number().over(Window.partitionBy("header").orderBy(ROW, "value"))
    return firsts.withColumn("place", place).filter(F.col("place") <= count).select("header", "place", "value")


def identifier_columns(profiles: DataFrame, key: str | None, unique: float = 0.9, populated: float = 0.5, cap: int = 5) -> DataFrame:
    """header, position of text columns whose shared value suggests one entity: nearly unique and well filled."""
    chosen = profiles.filter((F.col("inferred_type") == "text") & (F.col("unique") >= unique) & (F.col("non_empty") >= populated))
    return chosen.filter(F.col("header") != (key or "")).orderBy("position").limit(cap).select("header", "position")
