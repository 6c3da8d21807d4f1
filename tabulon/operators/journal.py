"""Folds over append-only logs: rows, effects, requirements, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.operators.corrections import revoked
from tabulon.operators.dedup import numbered
from tabulon.sources.shared import written

STATUSES = ("created", "skipped", "failed")
UNDO = ("delete_record", "delete_custom_field", "restore_override", "remove_record_link", "restore_record", "correction_revoke")
IDENTITY = ("kind", "source", "target", "doctype", "field")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL log; lines that don't parse are left out."""
    read = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return read.filter("_corrupt_record is null").drop("_corrupt_record")


def read_runs(spark: SparkSession, folder: str | list[str], schema: str) -> DataFrame:
    """All logs of a folder, or those named: run (the file's name without suffix), modified (when it was written last), seq (the line's order in its file), and the fields.

    A line's place is that of its block and its order in the block, whatever order Spark deals blocks out in.
    """
    read = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(folder)
    at, place = F.monotonically_increasing_id(), ("__file", "__block")
    lines = read.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.col("_metadata.file_modification_time").alias("modified"))
    lines = written(lines.withColumn("__at", at), "log")
    first = lines.groupBy(*place).agg(F.min("__at").alias("__first"))
    named = F.regexp_extract("__file", r"([^/]+?)(\.[^./]*)*$", 1)
    out = lines.filter("_corrupt_record is null").join(first, list(place)).withColumn("run", named).withColumn("seq", F.col("__block") + F.col("__at") - F.col("__first"))
    return out.drop("_corrupt_record", "__at", "__first", *place)


def log_counts(log: DataFrame) -> DataFrame:
    """status, count."""
    return log.groupBy("status").agg(F.count("*").alias("count"))


def journal_effects(log: DataFrame) -> DataFrame:
    """The effects of a run in order, without those of later reverts."""
    return log.filter("event = 'effect'").orderBy("seq")


def revert_plan(log: DataFrame, op: str = "op") -> DataFrame:
    """step (from 1), seq, op, known of the effects to undo, last first."""
    effects = log.filter("event = 'effect'").select("seq", F.col(op).alias("op"))
    steps = numbered(effects, F.desc("seq"), name="step", first=1)
    return steps.select(F.col("step").cast("long").alias("step"), "seq", "op", F.coalesce(F.col("op").isin(*UNDO), F.lit(False)).alias("known"))


def is_reverted(log: DataFrame) -> bool:
    """Whether the last revert marker says that all effects were undone."""
    facts = log.agg(F.count(F.when(F.col("event") == "effect", 1)).alias("effects"), F.max_by(F.struct("status", "reverted"), F.when(F.col("event") == "revert", F.col("seq"))).alias("last")).first()
    return facts["last"] is not None and facts["last"]["status"] == "ok" and (facts["last"]["reverted"] or 0) >= facts["effects"]


def undone(tables: dict[str, DataFrame], log: DataFrame, keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables that a journal changed, as they are after its effects are undone, last effect first.

    log: seq, event, op, doctype, name, fields (map of what to restore), link_doctype, link_name. Of several values to
    restore the oldest effect's is the last to be written, so it stays; a record that is deleted isn't restored; what
    is gone already is passed over, so undoing twice changes nothing more. Tables: key (by default `name`), and `links` where links go.
    """
    effects, out = log.filter("event = 'effect'"), {}
    for doctype, table in tables.items():
        key = (keys or {}).get(doctype, "name")
        own = effects.filter(F.col("doctype") == doctype)
        gone = own.filter(F.col("op").isin("delete_record", "delete_custom_field")).select(F.col("name").alias("__k")).distinct()
        cells = own.filter("op = 'restore_record'").select("seq", F.col("name").alias("__k"), F.explode("fields").alias("f", "v"))
        cells = cells.groupBy("__k", "f").agg(F.min_by("v", "seq").alias("v"))
        back = cells.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("__back"))
        named = table.withColumn("__k", F.col(key).cast("string")).join(gone, "__k", "left_anti").join(back, "__k", "left")
        new = {c: F.when(F.map_contains_key("__back", F.lit(c)), F.try_element_at("__back", F.lit(c)).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c in table.columns if c not in (key, "links")}
        named = named.withColumns({c: F.when(F.col("__back").isNull(), F.col(c)).otherwise(v) for c, v in new.items()})
        if "links" in table.columns:
            cut = own.filter("op = 'remove_record_link'").groupBy(F.col("name").alias("__k")).agg(F.collect_set(F.struct("link_doctype", "link_name")).alias("__cut"))
            pair = lambda x: F.struct(x["link_doctype"].alias("link_doctype"), x["link_name"].alias("link_name"))
            named = named.join(cut, "__k", "left")
            named = named.withColumn("links", F.when(F.col("__cut").isNull(), F.col("links")).otherwise(F.filter("links", lambda x: ~F.array_contains("__cut", pair(x)))))
        out[doctype] = named.select(*table.columns)
    return out


def settings_undone(overrides: dict, fixes: list[dict], log: DataFrame, at: str) -> tuple[dict, list[dict]]:
    """(overrides, corrections) after the effects on them are undone: previous targets come back, added corrections are revoked.

    A run changes few settings, so their effects are the driver's.
    """
    own = log.filter(F.col("op").isin("restore_override", "correction_revoke") & (F.col("event") == "effect")).orderBy(F.desc("seq")).collect()
    made = {doctype: {k: dict(v) if k == "mappings" else v for k, v in value.items()} for doctype, value in overrides.items()}
    for e in own:
        if e["op"] == "correction_revoke":
            fixes = revoked(fixes, e["name"], at)
            continue
        mappings, previous = made.setdefault(e["doctype"], {}).setdefault("mappings", {}), (e["fields"] or {}).get("previous")
        if previous is None:
            mappings.pop(e["name"], None)
        else:
            mappings[e["name"]] = previous
    return made, fixes


def marker(log: DataFrame, run: str, status: str = "ok") -> DataFrame:
    """event, run, reverted, status: what is appended to a journal after a revert."""
    effects = log.filter("event = 'effect'").agg(F.count("*").alias("reverted"))
    return effects.select(F.lit("revert").alias("event"), F.lit(run).alias("run"), "reverted", F.lit(status).alias("status"))


def entries(changed: DataFrame, doctype: str, key: str, op: str) -> DataFrame:
    """event, op, doctype, name, fields: an effect for each row, with its other columns as what to restore."""
    others = [c for c in changed.columns if c != key and op == "restore_record"]
    fields = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*(F.col(c).cast("string") for c in others))) if others else F.lit(None).cast("map<string,string>")
    return changed.select(F.lit("effect").alias("event"), F.lit(op).alias("op"), F.lit(doctype).alias("doctype"), F.col(key).cast("string").alias("name"), fields.alias("fields"))


def append_log(entries: DataFrame, path: str) -> None:
    """Adds entries to a JSONL journal folder."""
    entries.write.mode("append").json(path)


def run_summary(log: DataFrame) -> DataFrame:
    """run, modified, effects, reverted of each run; log: run, seq, event, status, reverted, modified (of its file)."""
    last = F.max_by(F.struct("status", "reverted"), F.when(F.col("event") == "revert", F.col("seq")))
    facts = log.groupBy("run").agg(F.max("modified").alias("modified"), F.count(F.when(F.col("event") == "effect", 1)).alias("effects"), last.alias("last"))
    whole = F.col("last").isNotNull() & (F.col("last.status") == "ok") & (F.coalesce("last.reverted", F.lit(0)) >= F.col("effects"))
    return facts.select("run", "modified", "effects", whole.alias("reverted"))


def latest_run(runs: DataFrame, require_effects: bool = False) -> DataFrame:
    """The newest run that is not reverted, of those with effects if asked for and there are any; else the newest; one row, or none."""
    wanted = F.when(F.col("reverted"), 0).when(F.lit(require_effects) & (F.col("effects") > 0), 2).otherwise(1)
    return runs.orderBy(wanted.desc(), F.desc("modified"), "run").limit(1)


def run_view(log: DataFrame) -> DataFrame:
    """run, requirements, satisfied, effects, config_deltas of each run."""
    n = lambda event: F.count(F.when(F.col("event") == event, 1)).cast("long")
    return log.groupBy("run").agg(n("requirement").alias("requirements"), n("requirement_satisfied").alias("satisfied"), n("effect").alias("effects"), n("config_delta").alias("config_deltas"))


def retention(files: DataFrame, group: str, stamp: str, keep: int, protect: Column | None = None) -> DataFrame:
    """files with place (1 is the newest of its group) and drop."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(stamp)))
    old = F.col("place") > keep
    return files.withColumn("place", place).withColumn("drop", old if protect is None else old & ~protect)


def warning_digest(warnings: DataFrame, cap: int = 5) -> DataFrame:
    """cause, count, first_seen of the most frequent causes, and single_cause; warnings: __row, message ('<where> failed: <cause>').

    single_cause: every one of several warnings has the same cause, so the target is at fault rather than the rows.
    """
    text = F.trim(F.regexp_replace("message", r"\s+", " "))
    at = F.instr(text, " failed: ")
    cause = F.substring(F.when(at > 0, F.trim(F.substring(text, at + 9, F.length(text)))).otherwise(text), F.lit(1), F.lit(220))
    where = F.when(at > 0, F.left(text, at - 1)).otherwise(text)
    rows = warnings.select("__row", cause.alias("cause"), where.alias("where"))
    top = rows.groupBy("cause").agg(F.count("*").alias("count"), F.min_by("where", "__row").alias("first_seen")).orderBy(F.desc("count"), "cause").limit(max(cap, 2))
    top = written(top, "digest")
    return top.withColumn("single_cause", F.lit(top.count() == 1) & (F.col("count") > 1)).orderBy(F.desc("count"), "cause").limit(cap)


def requirement_state(events: DataFrame) -> DataFrame:
    """Each requirement's identity with state (open, satisfied, reopened), how many times it was met, and by what last (via).

    events: seq, event (requirement, requirement_satisfied) and the identity's columns. A requirement recorded again
    while it is open adds nothing; after being met it is reopened.
    """
    ident = [F.coalesce(c, F.lit("")).alias(c) for c in IDENTITY]
    via = F.coalesce("via", F.lit("effect")) if "via" in events.columns else F.lit("effect")
    rows = events.filter(F.col("event").isin("requirement", "requirement_satisfied")).select("seq", "event", via.alias("via"), *ident)
    last = F.max_by("event", "seq")
    met = F.count(F.when(F.col("event") == "requirement_satisfied", 1))
    state = F.when(last == "requirement_satisfied", "satisfied").when(met > 0, "reopened").otherwise("open")
    return rows.groupBy(*IDENTITY).agg(state.alias("state"), met.alias("met"), F.max_by("via", F.when(F.col("event") == "requirement_satisfied", F.col("seq"))).alias("via"))


def covered(requirements: DataFrame, created: DataFrame) -> DataFrame:
    """id, missing (sorted values still absent), satisfied; requirements: id, doctype, missing_values; created: doctype, name."""
    wanted = requirements.select("id", "doctype", F.explode_outer("missing_values").alias("name"))
    there = created.select("doctype", "name").distinct().withColumn("there", F.lit(True))
    left = wanted.join(there, ["doctype", "name"], "left").filter("there is null and name is not null")
    absent = left.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("missing"))
    out = requirements.select("id").join(absent, "id", "left")
    return out.select("id", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.col("missing").isNull().alias("satisfied"))


def stall_rounds(rounds: DataFrame) -> DataFrame:
    """round, conflicts, stalled: rounds in a row whose outstanding errors are the same; rounds: round, fingerprint."""
    sets = rounds.groupBy("round").agg(F.array_sort(F.collect_set("fingerprint")).alias("f"))
    order = Window.orderBy("round")
    same = (F.size("f") > 0) & F.col("f").eqNullSafe(F.lag("f").over(order))
    runs = sets.withColumn("same", same).withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order))
    stalled = F.sum(F.col("same").cast("long")).over(Window.partitionBy("run").orderBy("round"))
    return runs.select("round", F.size("f").cast("long").alias("conflicts"), stalled.alias("stalled"))
