"""Hierarchies that refer to themselves: parents first, cycles last, groups marked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.convert import to_int
from tabulon.functions.text import strip
from tabulon.operators.profile import ROW
from tabulon.sources.shared import new_folder, removed, stored


def _met(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """A left join by shuffles: files of names are small next to what they hold, so Spark would send them through the driver, in each round."""
    return left.join(right.hint("merge"), on, "left")


def _climbed(steps: DataFrame, path: str) -> DataFrame:
    """n, d, at from steps (n, up, d, at): d is the way from n to the end above it, null in a cycle, below one or where the end's d is; at is the end's.

    An end has no up. Pointers double: after r rounds each name knows its ancestor 2^r steps up, so a chain of a billion
    names takes thirty rounds. A round that finds nobody's end is the last: a longer way would lead through a name that it found.
    """
    spark, turn = steps.sparkSession, 0
    steps, left = stored(steps, f"{path}/0"), None
    while (under := steps.filter("up is not null").count()) not in (0, left):
        left, turn = under, turn + 1
        above = steps.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("at").alias("at2"))
        moved = _met(steps.filter("up is not null").drop("at"), above, "up").select("n", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), F.col("at2").alias("at"))
        steps = stored(steps.filter("up is null").unionByName(moved), f"{path}/{turn}")
        removed(spark, f"{path}/{turn - 1}")
    ended = F.col("up").isNull()
    return steps.select("n", F.when(ended, F.col("d")).alias("d"), F.when(ended, F.col("at")).alias("at"))


def _lowest(ways: DataFrame, path: str) -> DataFrame:
    """n, d: the shortest way out of n by ways (n, at, d: at is d steps above n, or, if null, the way is out), null without one.

    Each n takes the way that is best by what is known, all climb what they took, and so on until no way is better than
    what its n has. A turn settles at least the names one more way off, mostly far more. Of equal ways, as those of names
    that know no way out yet, the name that sorts first is taken: where names follow an order all try one direction.
    """
    spark, turn, far = ways.sparkSession, 0, F.lit(1 << 62)
    known = ways.select("n").distinct().withColumn("d", F.lit(None).cast("long"))
    while True:
        out = ways.filter("at is null").select("n", "at", "d", F.col("d").alias("all"))
        over = _met(ways.filter("at is not null"), known.select(F.col("n").alias("at"), F.col("d").alias("rest")), "at").select("n", "at", "d", F.coalesce(F.col("d") + F.col("rest"), far).alias("all"))
        best = out.unionByName(over).groupBy("n").agg(F.min_by(F.struct("at", "d"), F.struct("all", "at")).alias("way"), F.min("all").alias("all"))
        taken = stored(_met(best, known, "n").select("n", F.col("way.at").alias("up"), F.col("way.d").alias("d"), F.lit(None).cast("string").alias("at"), (F.col("all") < F.coalesce("d", far)).alias("better")), f"{path}/taken-{turn}")
        if not taken.filter("better").limit(1).count():
            return known
        known = _climbed(taken.drop("better"), f"{path}/{turn}").select("n", "d")
        removed(spark, f"{path}/taken-{turn}")
        removed(spark, f"{path}/{turn - 1}")
        turn += 1


def levels(sheet: DataFrame, name: str, parent: str) -> DataFrame:
    """sheet with level: 0 without a parent in the sheet, else one more than the parent's; null in a cycle or below one.

    Of rows with one name the lowest level counts for their children. Names with one parent climb to where the way out is
    known or to a name with several; only between those ways are compared.
    """
    rows = sheet.withColumn("__name", strip(F.col(f"`{name}`"))).withColumn("__parent", strip(F.col(f"`{parent}`")))
    names = rows.filter("__name <> ''").select(F.col("__name").alias("__known")).distinct()
    edges = _met(rows.filter("__name <> ''").select(F.col("__name").alias("n"), "__parent"), names, F.col("__parent") == F.col("__known")).select("n", F.col("__known").alias("up"))
    # a name is free as soon as one of its rows is; to hang on itself leads nowhere
    other = F.when(F.col("up") != F.col("n"), F.col("up"))
    facts = edges.groupBy("n").agg(F.max(F.col("up").isNull()).alias("free"), F.min(other).alias("low"), F.max(other).alias("high"))
    fork = ~F.col("free") & (F.col("low") != F.col("high"))
    path = new_folder(sheet.sparkSession, "tree")
    steps = facts.select("n", F.when(~F.col("free") & (F.col("low") == F.col("high")), F.col("low")).alias("up"), F.when(F.col("free") | fork, 0).when(F.col("low").isNotNull(), 1).cast("long").alias("d"), F.when(fork, F.col("n")).alias("at"))
    climbed = _climbed(steps, f"{path}/names")
    forks = climbed.filter("n = at").select("n")
    if forks.limit(1).count():
        several = edges.join(forks.hint("merge"), "n", "left_semi").filter("up <> n").distinct()
        ways = _met(several, climbed.select(F.col("n").alias("up"), (F.col("d") + 1).alias("d"), "at"), "up").filter("d is not null and (at is null or at <> n)")
        ways = stored(ways.groupBy("n", "at").agg(F.min("d").alias("d")), f"{path}/ways")
        rest = _lowest(ways, f"{path}/forks").select(F.col("n").alias("at"), F.col("d").alias("rest"))
        below = _met(climbed.filter("at is not null"), rest, "at").select("n", (F.col("d") + F.col("rest")).alias("d"))
        climbed = climbed.filter("at is null").select("n", "d").unionByName(below)
    known = climbed.select(F.col("n").alias("__parent"), (F.col("d") + 1).alias("__above"), F.lit(True).alias("__inside"))
    return _met(rows, known, "__parent").withColumn("level", F.when(F.col("__inside").isNull(), F.lit(0).cast("long")).otherwise(F.col("__above"))).select(*sheet.columns, "level")


def parents_first(levelled: DataFrame) -> DataFrame:
    """Rows in an order in which parents precede children; members of cycles and what hangs on them last."""
    return levelled.orderBy(F.coalesce("level", F.lit((1 << 62))), ROW)


def stuck(levelled: DataFrame) -> DataFrame:
    """Rows in a cycle, or below one."""
    return levelled.filter("level is null")


def mark_groups(sheet: DataFrame, name: str, parent: str, is_group: str | None = None) -> DataFrame:
    """sheet with is_group: the explicit value, read as a Check (yes and no count), else 1 if a row names it as parent, else 0."""
    parents = sheet.select(strip(F.col(f"`{parent}`")).alias("__p")).filter("__p <> ''").distinct().withColumn("__g", F.lit(1))
    joined = sheet.withColumn("__n", strip(F.col(f"`{name}`"))).join(parents, F.col("__n") == F.col("__p"), "left")
    explicit = to_int(F.col(f"`{is_group}`")).cast("int") if is_group else F.lit(None).cast("int")
    keep = [c for c in sheet.columns if c != "is_group"]
    return joined.withColumn("is_group", F.coalesce(explicit, "__g", F.lit(0))).select(*keep, "is_group")
