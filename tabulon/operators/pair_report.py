"""The first near-duplicate pairs of a sheet in the order of their rows, without listing the others.

Pairs come from relations between sets of rows: the rows of one comparison key (a class) with each other, those with
the same words (a group) with each other, the rows of two near classes, and single pairs that share an identifier. In
each relation only rows with different duplicate keys (kinds) pair up.

A relation's least pair follows from the least rows of its kinds. Each pair is in few relations, so the relations with
the least pairs hold the first pairs of all. And of a relation only its first rows can be in them: of one kind no
further than 2 * cap + 1, and after 4 * (cap + 1) of such rows others have long given enough pairs. So neither a class
with half of all rows nor many classes cost more than their scan and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import strip, within_distance
from tabulon.operators.neardup import SIGNALS, close_strings, identifier_pairs, keyed_rows
from tabulon.operators.profile import ROW, headers
from tabulon.sources.shared import written


def _first(rows: DataFrame, by: list[str], order: list[str], count: int) -> DataFrame:
    """The first rows of each group. Spark keeps `count` of each in every task already, before it moves them."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= count).drop("__k")


def _least_inside(kinds: DataFrame, by: str) -> DataFrame:
    """relation, a_row, b_row: the least pair of each set of rows with several kinds."""
    two = _first(kinds, [by], ["m"], 2).groupBy(by).agg(F.min("m").alias("a_row"), F.max("m").alias("b_row"))
    return two.filter("a_row < b_row").select(F.lit(by).alias("relation"), F.col(by).alias("x"), F.col(by).alias("y"), "a_row", "b_row")


def first_pairs(sheet: DataFrame, key: str, identifiers: list[str], compare: list[str] | None = None, cap: int = 25, k: int = 2) -> DataFrame:
    """What near_duplicate_pairs gives, in its first `cap` rows by (a_row, b_row)."""
    rows = keyed_rows(sheet, key)
    rows = written(rows.select(ROW, "value", "ckey", F.md5("ckey").alias("c"), F.md5("signature").alias("s"), F.md5("dkey").alias("d")), "keyed")
    kinds = written(rows.groupBy("s", "c", "d").agg(F.min(ROW).alias("m")), "kinds")
    least = kinds.groupBy("c").agg(F.min("m").alias("m"))
    close = close_strings(rows, "ckey", k).select(F.md5("a").alias("x"), F.md5("b").alias("y"))
    side = lambda x: least.select(F.col("c").alias(x), F.col("m").alias(f"m{x}"))
    near = close.join(side("x"), "x").join(side("y"), "y").select(F.lit("near").alias("relation"), "x", "y", F.least("mx", "my").alias("a_row"), F.greatest("mx", "my").alias("b_row"))
    shared = written(identifier_pairs(sheet, key, identifiers), "shared")
    single = shared.select(F.lit("pair").alias("relation"), F.lit("").alias("x"), F.lit("").alias("y"), "a_row", "b_row").distinct()
    # a pair is in one class or near pair of classes, in one group, and once among those that share identifiers
    relations = _least_inside(kinds, "c").union(_least_inside(kinds.groupBy("s", "d").agg(F.min("m").alias("m")), "s")).union(near).union(single)
    relations = written(relations.orderBy("a_row", "b_row").limit(3 * cap), "relations")

    def members(by: str, names: DataFrame) -> DataFrame:
        own = rows.select(ROW, by, "d").join(F.broadcast(names.distinct()), by, "left_semi")  # of at most 6 * cap sets
        return _first(_first(own, [by, "d"], [ROW], 2 * cap + 1), [by], [ROW], 4 * (cap + 1))

    of = lambda name: relations.filter(F.col("relation") == name)
    found = of("pair").select("a_row", "b_row")
    for by, names, links in (("c", of("c").union(of("near")), of("c").union(of("near"))), ("s", of("s"), of("s"))):
        sets = written(members(by, names.select(F.col("x").alias(by)).union(names.select(F.col("y").alias(by)))), "members")
        one = lambda x, sets=sets, by=by: sets.select(F.col(by).alias(x), F.col(ROW).alias(f"r{x}"), F.col("d").alias(f"d{x}"))
        both = links.select("x", "y").join(one("x"), "x").join(one("y"), "y").filter("dx <> dy")
        found = found.union(both.select(F.least("rx", "ry").alias("a_row"), F.greatest("rx", "ry").alias("b_row")))
    pairs = written(found.distinct().orderBy("a_row", "b_row").limit(cap), "pairs")
    return described(sheet, rows, pairs, shared, key, compare, k)


def described(sheet: DataFrame, rows: DataFrame, pairs: DataFrame, shared: DataFrame, key: str, compare: list[str] | None, k: int) -> DataFrame:
    """A few pairs with their values, distance, signals and fields that are shared or differ."""
    others = [h for h in (compare if compare is not None else headers(sheet)) if h != key and h in sheet.columns]
    cells = F.array(*(strip(F.col(f"`{h}`")) for h in others)) if others else F.array().cast("array<string>")
    named = pairs.select(F.explode(F.array("a_row", "b_row")).alias(ROW)).distinct()
    full = sheet.select(ROW, cells.alias("cells")).join(F.broadcast(named), ROW, "left_semi").join(rows.join(F.broadcast(named), ROW, "left_semi"), ROW)
    side = lambda x: full.select(F.col(ROW).alias(f"{x}_row"), F.col("value").alias(f"{x}_value"), F.col("ckey").alias(f"{x}_ckey"), F.col("s").alias(f"{x}_s"), F.col("cells").alias(f"{x}_cells"))
    fields = shared.join(F.broadcast(pairs), ["a_row", "b_row"], "left_semi").groupBy("a_row", "b_row").agg(F.array_sort(F.collect_set("field")).alias("shared_fields"))
    both = pairs.join(side("a"), "a_row").join(side("b"), "b_row").join(fields, ["a_row", "b_row"], "left")
    signals = (within_distance(F.col("a_ckey"), F.col("b_ckey"), k), F.col("a_s") == F.col("b_s"), F.col("shared_fields").isNotNull())
    names = F.array_compact(F.array(*(F.when(holds, name) for holds, name in zip(signals, SIGNALS, strict=True))))
    differing = F.array_compact(F.array(*(F.when(F.get("a_cells", F.lit(i)) != F.get("b_cells", F.lit(i)), h) for i, h in enumerate(others)))) if others else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    out = both.select("a_row", "a_value", "b_row", "b_value", F.levenshtein("a_ckey", "b_ckey").alias("edit_distance"), names.alias("signals"), F.coalesce("shared_fields", none).alias("shared_fields"), differing.alias("differing_fields"))
    return out.orderBy("a_row", "b_row")
