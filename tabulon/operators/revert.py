"""Undoing a run's journal, with an outcome for each effect.

Effects are undone last first. That order matters between the effects of one record, and where a record that the run
made is a parent of others: it can only go after them. Records are taken level by level, from those that nothing
refers to; what still holds a record keeps it, and with it all that it refers to. An effect that is unknown or can't be
undone fails alone. A marker says that a journal is done only if all of it is; what is done already is passed over, so
a revert that failed in part is resumed by reverting again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import journal
from tabulon.sources.shared import hadoop, new_folder, removed, stored, written

DELETES = ("delete_record", "delete_custom_field")
ON_RECORDS = ("restore_record", "remove_record_link")


@dataclass(frozen=True)
class Reference:
    """Rows of child name a record of parent in column."""

    child: str
    column: str
    parent: str


@dataclass(frozen=True)
class Reverted:
    """results: seq, op, doctype, name, description, ok, error (last effect first by seq); tables as they are then;
    marker: what to append to the journal, if all is well and something was to do."""

    results: DataFrame
    tables: dict[str, DataFrame]
    marker: DataFrame | None
    total: int
    applied: int
    already: bool = False


def description() -> F.Column:
    """What undoing an effect does, in words."""
    where, fields = F.concat_ws("/", "doctype", "name"), F.array_join(F.array_sort(F.map_keys("fields")), ", ")
    before = F.try_element_at("fields", F.lit("previous"))
    words = {
        "delete_record": F.concat(F.lit("delete "), where), "delete_custom_field": F.concat(F.lit("drop field "), F.col("name")),
        "restore_override": F.concat(F.lit("restore the target of "), F.concat_ws(".", "doctype", "name"), F.coalesce(F.concat(F.lit(" to "), before), F.lit(" to none"))),
        "remove_record_link": F.concat(F.lit("unlink "), F.concat_ws("/", "link_doctype", "link_name"), F.lit(" from "), where),
        "restore_record": F.concat(F.lit("restore "), where, F.lit(" "), F.when(F.size(F.map_keys("fields")) > 0, fields).otherwise("(no fields)")),
        "correction_revoke": F.concat(F.lit("revoke correction "), F.col("name")),
    }
    out = F.concat(F.lit("unknown effect "), F.coalesce("op", F.lit("")))
    for op, text in words.items():
        out = F.when(F.col("op") == op, text).otherwise(out)
    return out


def whole(log: DataFrame) -> DataFrame:
    """log with all columns that an effect can have."""
    kinds = {"seq": "long", "event": "string", "op": "string", "doctype": "string", "name": "string", "fields": "map<string,string>", "link_doctype": "string", "link_name": "string", "status": "string", "reverted": "long"}
    return log.select(*(F.col(c).cast(k).alias(c) if c in log.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def held(spark: SparkSession, going: DataFrame, tables: dict[str, DataFrame], keys: dict[str, str], references: tuple[Reference, ...]) -> DataFrame:
    """doctype, name, by of the records in going (doctype, name) that can't go, because one that stays refers to them.

    A round takes those that are held directly out of going; the next one finds what those hold.
    """
    none = spark.createDataFrame([], "doctype string, name string, by string")
    if not references:
        return none
    out, path = none, new_folder(spark, "going")
    going = stored(going, path)
    while True:
        found = none
        for r in references:
            if r.child in tables and r.parent in tables:
                rows = tables[r.child].select(F.col(keys.get(r.child, "name")).cast("string").alias("child"), F.col(r.column).cast("string").alias("name")).filter("name is not null")
                rows = rows.join(going.filter(F.col("doctype") == r.parent).select("name"), "name", "left_semi")
                if r.child == r.parent:
                    rows = rows.filter("child <> name")  # a record that names itself goes with itself
                rows = rows.join(going.filter(F.col("doctype") == r.child).select(F.col("name").alias("child")), "child", "left_anti")
                found = found.union(rows.select(F.lit(r.parent), "name", F.concat(F.lit(f"{r.child}/"), "child")))
        found = written(found.groupBy("doctype", "name").agg(F.min("by").alias("by")), "held")
        if not found.limit(1).count():
            return out
        out = out.union(found)
        before, path = path, new_folder(spark, "going")
        going = stored(going.join(found, ["doctype", "name"], "left_anti"), path)
        removed(spark, before)


def judged(tables: dict[str, DataFrame], effects: DataFrame, keys: dict[str, str], references: tuple[Reference, ...]) -> DataFrame:
    """effects with error: why each can't be undone, or null."""
    spark = effects.sparkSession
    columns = F.create_map(*(x for t, df in tables.items() for x in (F.lit(t), F.array(*map(F.lit, df.columns))))) if tables else F.lit(None).cast("map<string,array<string>>")
    own = F.try_element_at(columns, F.col("doctype"))
    unknown = F.filter(F.map_keys("fields"), lambda f: ~F.array_contains(own, f))
    acts = F.col("op").isin(*DELETES, *ON_RECORDS)
    nothing = (F.col("op") == "restore_record") & (F.coalesce(F.size(F.map_keys("fields")), F.lit(0)) <= 0)
    error = F.when(~F.coalesce(F.col("op").isin(*journal.UNDO), F.lit(False)), F.concat(F.lit("unknown effect "), F.coalesce("op", F.lit(""))))
    error = error.when(nothing, None).when(acts & (F.col("op") != "delete_custom_field") & own.isNull(), F.concat(F.lit("no table "), F.coalesce("doctype", F.lit(""))))
    error = error.when((F.col("op") == "restore_record") & (F.size(unknown) > 0), F.concat(F.lit("no field "), F.array_join(unknown, ", ")))
    error = error.when((F.col("op") == "remove_record_link") & ~F.array_contains(own, "links"), F.concat(F.lit("no links in "), F.col("doctype")))
    rows = written(effects.withColumn("error", error).withColumn("nothing", nothing), "effects")

    there = None
    for t, df in tables.items():
        one = df.select(F.lit(t).alias("doctype"), F.col(keys.get(t, "name")).cast("string").alias("name")).distinct()
        there = one if there is None else there.union(one)
    there = there if there is not None else spark.createDataFrame([], "doctype string, name string")
    restored = journal.undone(tables, rows.filter("error is null and op = 'restore_record'"), keys)
    gone = rows.filter(F.col("op").isin(*DELETES) & F.col("error").isNull()).groupBy("doctype", "name").agg(F.max("seq").alias("gone_at"))
    going = written(gone.join(there, ["doctype", "name"], "left_semi"), "gone")
    stuck = held(spark, going.select("doctype", "name"), restored, keys, references)
    rows = rows.join(stuck, ["doctype", "name"], "left").join(going.join(stuck, ["doctype", "name"], "left_anti"), ["doctype", "name"], "left").join(there.withColumn("there", F.lit(True)), ["doctype", "name"], "left")
    late = F.when(F.col("op").isin(*DELETES) & F.col("by").isNotNull(), F.concat(F.lit("still referred to by "), F.col("by")))
    late = late.when(F.col("op").isin(*ON_RECORDS) & ~F.col("nothing") & (F.col("there").isNull() | (F.col("gone_at") > F.col("seq"))), F.concat(F.lit("no record "), F.concat_ws("/", "doctype", "name")))
    return rows.withColumn("error", F.coalesce("error", late)).drop("nothing", "by", "gone_at", "there")


def reverted(tables: dict[str, DataFrame], log: DataFrame, keys: dict[str, str] | None = None, references: tuple[Reference, ...] = (), run: str = "", apply: bool = True, force: bool = False) -> Reverted:
    """Undoes the effects of a run's journal in tables.

    apply False: what would be undone, with nothing changed or judged. force: also where a marker says that all is undone.
    """
    log, keys = whole(log), keys or {}
    effects = written(log.filter("event = 'effect'"), "journal")
    if apply and not force and journal.is_reverted(log) and effects.limit(1).count():
        return Reverted(effects.limit(0).select("seq", "op", "doctype", "name", F.lit("").alias("description"), F.lit(True).alias("ok"), F.lit("").alias("error")), tables, None, effects.count(), 0, True)
    rows = written(judged(tables, effects, keys, references), "judged") if apply else effects.withColumn("error", F.lit(None).cast("string"))
    results = rows.select("seq", "op", "doctype", "name", description().alias("description"), F.col("error").isNull().alias("ok"), F.coalesce("error", F.lit("")).alias("error")).orderBy(F.desc("seq"))
    total, good = rows.agg(F.count("*"), F.count(F.when(F.col("error").isNull(), 1))).first()
    if not apply:
        return Reverted(results, tables, None, total, total)
    after = journal.undone(tables, rows.filter("error is null"), keys)
    return Reverted(results, after, journal.marker(effects, run) if total and good == total else None, total, good)


def prune(spark: SparkSession, folder: str, keep: int = 20, protect: str = "", prefix: str = "journal-") -> tuple[list[str], list[str]]:
    """Deletes the oldest journals of a folder beyond the newest `keep`, by the stamp that ends their names.

    (deleted, kept though too many): a journal with effects that aren't undone stays, as does the one that is open
    (protect). Its last change is no guide, since a revert is one.
    """
    files, top = hadoop(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
    own = sorted((n for n in names if n.startswith(prefix) and n.endswith(".jsonl")), key=lambda n: (m[0] if (m := re.search(r"\d{8}-\d{6,}(?=\.jsonl$)", n)) else "", n), reverse=True)
    old = [n for n in own[keep:] if n != protect.rpartition("/")[2]]
    if not old:
        return [], []
    paths = [f"{folder.rstrip('/')}/{n}" for n in old]
    log = journal.read_runs(spark, paths, "event string, status string, reverted long")
    live = {r["run"] for r in journal.run_summary(log).filter("effects > 0 and not reverted").collect()}  # one row a file
    kept = [n for n in old if n.removesuffix(".jsonl") in live]
    gone = [n for n in old if n not in kept]
    for n in gone:
        removed(spark, f"{folder.rstrip('/')}/{n}")
    return gone, sorted(kept)
