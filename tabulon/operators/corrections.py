"""Recorded corrections: keyed patches of a sheet, and what they make of the sheet's conflicts.

A correction is a JSON object: action, conflict (what it answers), reason, and
  set_value: at, column, value, from (what the cell held when the correction was first seen)
  skip_row: at
  merge_rows: keep, drop, field_overrides
  change_key: column, which later references by key use
A reference (at, keep, drop) is a key, resolved in the correction's key_column, or {"row": number}. id, key_column,
from and source_sha256 are filled in when a correction is first applied (`completed`).

Corrections come in an order, since later ones see what earlier ones did. But only those that name common rows or
keys can see each other, so such components are folded, each in its order by its own group, against the rows they
name. The sheet itself is never moved: what comes out is a table of patches, one of dropped rows, one of verdicts.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions.text import strip
from tabulon.operators.components import roots
from tabulon.operators.profile import ROW, headers
from tabulon.sources.shared import written

ACTIONS = ("set_value", "skip_row", "merge_rows", "dismiss_conflict", "change_key")
NEEDS_REASON = ("skip_row", "dismiss_conflict", "change_key")
#: What is filled in; it doesn't make a correction another one.
FILLED = ("id", "by", "created_at", "created_by", "key_column", "from", "source_sha256", "reason", "note", "revoked_at", "revoked_reason")


def text(value: object) -> str:
    return "" if value is None else str(value).strip()


def normal(c: dict) -> dict:
    """The correction with today's names for what has had others (ref, to, rows, values)."""
    out = dict(c)
    if "ref" in out:
        out.setdefault("at", out.pop("ref"))
    if "to" in out:
        out.setdefault("value", out.pop("to"))
    if "rows" in out:
        named = out.pop("rows")
        out.setdefault("drop", [r for r in named if r != out.get("keep")])
        if out.get("keep") not in named:
            out.pop("keep", None)
    if "values" in out:
        out.setdefault("field_overrides", out.pop("values"))
    return out


def identity(correction: dict) -> str:
    """The same for corrections that decide the same."""
    said = {k: v for k, v in normal(correction).items() if k not in FILLED and not (v is None or v == {})}
    if isinstance(said.get("drop"), list):
        said["drop"] = sorted(said["drop"], key=lambda r: json.dumps(r, sort_keys=True, default=str))
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()[:12]


def added(corrections: list[dict], new: dict) -> list[dict]:
    """corrections with new, once: one that is in force already isn't added, a revoked one may be decided anew."""
    check(new)
    if any(identity(c) == identity(new) for c in active(corrections)):
        return corrections
    name, taken = identity(new), {c.get("id") for c in corrections}
    named = name if name not in taken else next(f"{name}-{k}" for k in range(2, len(taken) + 3) if f"{name}-{k}" not in taken)
    return [*corrections, {"id": named} | new]


def revoked(corrections: list[dict], correction_id: str, at: str, reason: str = "reverted") -> list[dict]:
    """corrections with one no longer in force; it stays on record, with when and why."""
    gone = lambda c: c.get("id") == correction_id and not c.get("revoked_at")
    return [c | {"revoked_at": at, "revoked_reason": reason} if gone(c) else c for c in corrections]


def active(corrections: list[dict]) -> list[dict]:
    """Those in force."""
    return [c for c in corrections if not c.get("revoked_at")]


def merged(recorded: list[dict], completed: list[dict]) -> list[dict]:
    """recorded with its active corrections replaced, in order, by their completed copies; revoked ones stay as they are."""
    fresh, out = list(completed), []
    for c in recorded:
        out.append(c if c.get("revoked_at") or not fresh else fresh.pop(0))
    return out


def _refs(c: dict) -> list:
    if c.get("action") == "merge_rows":
        return [c.get("keep"), *(c["drop"] if isinstance(c.get("drop"), list) else [])]
    return [c.get("at")] if c.get("action") in ("set_value", "skip_row") else []


def wrong(correction: dict, columns: Iterable[str] | None = None) -> str:
    """Why a correction can't be used at all, or ''. columns: the sheet's, where they are known."""
    c = normal(correction)
    action, known = c.get("action"), None if columns is None else set(columns)
    if action not in ACTIONS:
        return f"unknown action {action!r}"
    if action in NEEDS_REASON and not text(c.get("reason")):
        return f"{action} needs a reason"
    if action == "dismiss_conflict" and not text(c.get("conflict")):
        return "dismiss_conflict needs a conflict"
    for ref in _refs(c):
        number = ref.get("row") if isinstance(ref, dict) and set(ref) == {"row"} else None
        if not (isinstance(ref, str) or isinstance(number, int) and not isinstance(number, bool)):
            return 'a row is referred to by its key (a string) or {"row": number}'
    written_to = list(c.get("field_overrides") or {}) if action == "merge_rows" else []
    if action in ("set_value", "change_key"):
        if not text(c.get("column")):
            return f"{action} needs a column"
        written_to = [c["column"]]
    if action == "set_value" and "value" not in c:
        return "set_value needs a value"
    if action == "merge_rows":
        if "keep" not in c or not isinstance(c.get("drop"), list):
            return "merge_rows needs the row to keep and a list of those to drop"
        if c["keep"] in c["drop"]:
            return "merge_rows drops the row that it keeps"
    unknown = [w for w in written_to if known is not None and w not in known]
    return f"no column {', '.join(map(repr, unknown))} in this sheet" if unknown else ""


def check(correction: dict) -> None:
    """Raises ValueError for a correction of the wrong shape."""
    if why := wrong(correction):
        raise ValueError(why)


def fingerprint(sheet: DataFrame) -> str:
    """A hash of headers, rows and their numbers, to tell whether a source is still the one that corrections were made on."""
    cells = F.array(F.col(ROW).cast("string"), *(F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")) for h in headers(sheet)))
    halves = [F.sum(F.xxhash64(F.lit(salt), cells).cast("decimal(38,0)")) for salt in (1, 2)]
    return hashlib.sha256(json.dumps([headers(sheet), *map(str, sheet.agg(F.count("*"), *halves).first())]).encode()).hexdigest()


def resolve(sheet: DataFrame, key: str, refs: Iterable[str]) -> DataFrame:
    """ref, hits, __row (where exactly one row has the key)."""
    wanted = sheet.sparkSession.createDataFrame([(r,) for r in sorted(set(refs))], "ref string")
    keyed = sheet.select(strip(F.col(f"`{key}`")).alias("ref"), ROW)
    hits = keyed.join(wanted, "ref", "left_semi").groupBy("ref").agg(F.count("*").alias("hits"), F.min(ROW).alias(ROW))
    out = wanted.join(hits, "ref", "left")
    return out.select("ref", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.when(F.col("hits") == 1, F.col(ROW)).alias(ROW))


# ---------------------------------------------------------------- the fold of one component


class Rows:
    """The rows that a component names, and which of them have which keys.

    many: keys with so many rows that corrections can't make them single; their rows aren't here.
    """

    def __init__(self, keys: Iterable[tuple[str, str]], many: Iterable[tuple[str, str]]) -> None:
        self.cells: dict[int, dict[str, str]] = {}
        self.having: dict[tuple[str, str], set[int]] = {k: set() for k in keys}
        self.many, self.dropped, self.changed = set(many), set(), defaultdict(dict)
        self.columns = {c for c, _ in self.having}

    def add(self, number: int, cells: dict[str, str]) -> None:
        self.cells[number] = cells
        for column in self.columns:
            if (column, text(cells.get(column))) in self.having:
                self.having[column, text(cells.get(column))].add(number)

    def put(self, number: int, column: str, value: object) -> None:
        value = "" if value is None else str(value)
        if column in self.columns:
            self.having.get((column, text(self.cells[number].get(column))), set()).discard(number)
            self.having.get((column, text(value)), set()).add(number)
        self.cells[number][column] = self.changed[number][column] = value

    def find(self, ref: str | dict, key_column: str, same_source: bool) -> tuple[int | None, str]:
        """(row, '') or (None, why there is none). Dropped rows count: what a key means doesn't change by dropping."""
        if isinstance(ref, dict):
            if not same_source:
                return None, "the sheet has changed since the correction was made, so its row number may mean another row"
            return (ref["row"], "") if ref["row"] in self.cells else (None, f"no row {ref['row']} in this sheet")
        if not key_column:
            return None, "no key column is known"
        found = self.having.get((key_column, ref), set())
        if (key_column, ref) in self.many or len(found) > 1:
            return None, f"several rows have {key_column} = {ref!r}; name one by its number"
        return (next(iter(found)), "") if found else (None, f"no row has {key_column} = {ref!r}")

    def apply(self, c: dict, key_column: str, same_source: bool) -> str:
        """Why the correction doesn't apply, or ''."""
        found = []
        for ref in _refs(c):
            number, why = self.find(ref, key_column, same_source)
            if why:
                return why
            if not found and number in self.dropped and c["action"] != "skip_row":  # what is set or kept must be there
                return "the row was dropped by an earlier correction"
            if found and number == found[0]:
                return "the row to keep is also to be dropped"
            found.append(number)
        if c["action"] == "set_value":
            now = text(self.cells[found[0]].get(c["column"]))
            if text(c.setdefault("from", now)) != now:
                return f"the cell now holds {now!r}, not {text(c['from'])!r}"
            self.put(found[0], c["column"], c["value"])
        elif c["action"] == "skip_row":
            self.dropped.add(found[0])  # a row that is gone already is what was wanted
        elif c["action"] == "merge_rows":
            for column, value in (c.get("field_overrides") or {}).items():
                self.put(found[0], column, value)
            self.dropped.update(found[1:])
        return ""


# ---------------------------------------------------------------- corrections as a table


@dataclass(frozen=True)
class Outcome:
    """verdicts: seq, id, action, conflict, applicable, invalid, why, completed (the correction's JSON, filled in);
    patches: __row, patch (map of cells); dropped: __row; key: the key column after all changes of key."""

    verdicts: DataFrame
    patches: DataFrame
    dropped: DataFrame
    key: str


def as_table(spark: SparkSession, corrections: list[dict]) -> DataFrame:
    """seq, body of the corrections of a list that are in force."""
    return spark.createDataFrame([(k, json.dumps(c, default=str)) for k, c in enumerate(active(corrections))], "seq long, body string")


def in_force(recorded: DataFrame) -> DataFrame:
    """Those of a table (seq, body) that aren't revoked."""
    return recorded.filter(F.get_json_object("body", "$.revoked_at").isNull())


def completed(recorded: DataFrame, outcome: Outcome) -> DataFrame:
    """seq, body of a table with its active corrections filled in, revoked ones as they are."""
    done = outcome.verdicts.select("seq", F.col("completed").alias("filled"))
    return recorded.select("seq", "body").join(done, "seq", "left").select("seq", F.coalesce("filled", "body").alias("body"))


READ = "seq long, body string, id string, action string, conflict string, why string, new_key string, own_key string, keys array<string>, numbers array<bigint>, writes array<struct<column: string, value: string>>"


def _read(columns: list[str]):
    """What the plan needs to know of each correction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in READ_ARROW]
            for seq, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                c = normal(json.loads(body))
                why = wrong(c, columns)
                refs = [] if why else _refs(c)
                writes = dict(c.get("field_overrides") or {}) if c.get("action") == "merge_rows" else {c["column"]: c["value"]} if c.get("action") == "set_value" and not why else {}
                new_key = c["column"] if c.get("action") == "change_key" and c.get("column") in columns else None
                keys, numbers = [x for x in refs if isinstance(x, str)], [x["row"] for x in refs if isinstance(x, dict)]
                row = (
                    seq, json.dumps(c, default=str), text(c.get("id")) or f"c{seq + 1}", text(c.get("action")), text(c.get("conflict")), why, new_key, c.get("key_column"), keys, numbers,
                    [] if why else [{"column": k, "value": text(v)} for k, v in writes.items()],
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, READ_ARROW, strict=True)], schema=READ_ARROW)

    return run


READ_ARROW = pa.schema([
    ("seq", pa.int64()), ("body", pa.string()), ("id", pa.string()), ("action", pa.string()), ("conflict", pa.string()), ("why", pa.string()), ("new_key", pa.string()), ("own_key", pa.string()),
    ("keys", pa.list_(pa.string())), ("numbers", pa.list_(pa.int64())), ("writes", pa.list_(pa.struct([("column", pa.string()), ("value", pa.string())]))),
])


def carried(df: DataFrame, order: str, value: str, first: str) -> DataFrame:
    """df with value replaced by its last one that isn't null in the rows before, at the beginning `first`."""
    part = F.spark_partition_id()
    ranged = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", part), "ranged")
    ends, now, begins = ranged.groupBy("__part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("v")).orderBy("__part").collect(), first, []
    for r in ends:  # one row a partition
        begins.append((r["__part"], now))
        now = r["v"] or now
    before = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = ranged.sparkSession.createDataFrame([*begins, (-1, now)], "__part int, __first string")
    return ranged.join(F.broadcast(known), "__part").withColumn(value, F.coalesce(F.last(value, True).over(before), "__first")).drop("__part", "__first")


def fold(sheet: DataFrame, key: str, corrections: DataFrame, sha256: str = "", apart: bool = True) -> Outcome:
    """Applies corrections (seq, body; those in force) in the order of seq.

    sha256: the sheet's fingerprint; a correction that carries another one can't name rows by number. apart: fold
    components by themselves; a short list is as well folded as one. A key that more rows have than corrections write
    to its column can't become single, so its rows are left out.
    """
    names = headers(sheet)
    read = written(corrections.select("seq", "body").mapInArrow(_read(names), READ), "corrections")
    changed = read.agg(F.max_by("new_key", F.when(F.col("new_key").isNotNull(), F.col("seq")))).first()[0]
    read = (read.withColumn("new_key", F.lit(key)) if changed is None else carried(read, "seq", "new_key", key)).withColumn("key_column", F.coalesce("own_key", "new_key"))
    twice = written(read.groupBy("id").agg(F.min("seq").alias("__seq"), F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")  # few, if any: so bodies needn't move
    read = read.join(twice, "id", "left").withColumn("why", F.when(F.col("seq") > F.col("__seq"), F.concat(F.lit("the id "), "id", F.lit(" is used twice"))).otherwise(F.col("why"))).drop("__seq")
    if changed is not None or twice.take(1):
        read = written(read, "corrections")
    good = read.filter("why = ''")

    keys = good.select("seq", F.col("key_column").alias("column"), F.explode("keys").alias("value"))
    wanted = written(keys.select("column", "value").distinct(), "keys")
    used = [r[0] for r in wanted.select("column").distinct().collect() if r[0] in names]  # columns of the sheet at most
    writes = good.select("seq", F.explode("writes").alias("w")).select("seq", "w.column", "w.value")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), strip(F.col(f"`{c}`")).alias("value")) for c in used))) if used else None
    none = sheet.sparkSession.createDataFrame([], f"column string, value string, {ROW} long")
    having = sheet.select(ROW, pairs.alias("p")).select(ROW, "p.column", "p.value").join(wanted, ["column", "value"], "left_semi") if used else none
    having = written(having.select("column", "value", ROW), "having")
    often = having.groupBy("column", "value").count().join(F.broadcast(writes.groupBy("column").agg(F.count("*").alias("writes"))), "column", "left")  # columns of the sheet at most
    many = written(often.filter(F.col("count") > F.coalesce("writes", F.lit(0)) + 1).select("column", "value"), "many")

    # Each key and each row belongs to the first correction that names it, and the others that do are linked to that one.
    # A key of many rows says the same to all, whatever they do: it links none, and each is told.
    new_keys = writes.join(wanted, ["column", "value"], "left_semi")  # a write may give a row a key that another correction names
    naming = written(keys.select("seq", "column", "value").union(new_keys.select("seq", "column", "value")).join(many, ["column", "value"], "left_anti"), "naming")
    of_key = written(naming.groupBy("column", "value").agg(F.min("seq").alias("first")), "firsts")
    by_number = good.select("seq", F.explode("numbers").alias(ROW))
    by_key = having.join(of_key, ["column", "value"]).select(F.col("first").alias("seq"), ROW)
    naming_rows = written(by_number.union(by_key), "naming")
    of_row = written(naming_rows.groupBy(ROW).agg(F.min("seq").alias("first")), "firsts")
    edges = naming.join(of_key, ["column", "value"]).select("seq", "first").union(naming_rows.join(of_row, ROW).select("seq", "first")).filter("seq <> first")
    group = roots(edges.select(F.col("seq").alias("a"), F.col("first").alias("b"))) if apart else None

    def grouped(df: DataFrame, seq: str) -> DataFrame:
        """df with part, the component of the correction seq: the first one in it."""
        if group is None:
            return df.withColumn("part", F.lit(0).cast("long"))
        return df.join(group.withColumnRenamed("node", seq), seq, "left").withColumn("part", F.coalesce("root", seq)).drop("root")

    body = F.to_json(F.struct(*(F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")).alias(h) for h in names)))
    said = F.to_json(F.struct("column", "value", F.col("many").alias("many")))
    told = of_key.withColumn("many", F.lit(False)).union(keys.join(many, ["column", "value"], "left_semi").select("column", "value", F.col("seq").alias("first"), F.lit(True)))
    blank = [F.lit("").alias(c) for c in ("key_column", "id", "action", "conflict")]
    rows = [
        grouped(told, "first").select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), said.alias("body"), *blank),
        sheet.join(grouped(of_row, "first").select(ROW, "part"), ROW).select("part", F.lit(1), F.col(ROW), body, *blank),
        grouped(good.select("seq", "body", "key_column", "id", "action", "conflict"), "seq").select("part", F.lit(2), "seq", "body", "key_column", "id", "action", "conflict"),
    ]
    packed = rows[0].union(rows[1]).union(rows[2]).repartition("part").sortWithinPartitions("part", "kind", "seq")
    folded = written(packed.mapInArrow(_folder(sha256), FOLDED), "folded")
    judged = folded.filter("kind = 2").select("seq", "id", "action", "conflict", (F.col("why") == "").alias("applicable"), F.lit(False).alias("invalid"), "why", F.col("said").alias("completed"))
    verdicts = judged.union(read.filter("why <> ''").select("seq", "id", "action", "conflict", F.lit(False), F.lit(True), "why", "body"))
    patches = folded.filter("kind = 1").select(F.col("seq").alias(ROW), F.from_json("said", "map<string,string>").alias("patch"))
    return Outcome(verdicts, patches, folded.filter("kind = 0").select(F.col("seq").alias(ROW)), changed or key)


FOLDED = "kind int, seq long, why string, said string, id string, action string, conflict string"
FOLDED_ARROW = pa.schema([("kind", pa.int32()), ("seq", pa.int64()), *((n, pa.string()) for n in ("why", "said", "id", "action", "conflict"))])


def _folder(sha256: str):
    """From rows (part, kind, seq, body, key_column, id, action, conflict) of keys, rows and corrections, sorted: kind 0 dropped rows, 1 patches, 2 verdicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, rows, out = None, {}, None, []

        def ended():
            if rows is not None:
                out.extend((0, n, None, None, None, None, None) for n in sorted(rows.dropped))
                out.extend((1, n, None, json.dumps(p), None, None, None) for n, p in sorted(rows.changed.items()))

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(FOLDED_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, FOLDED_ARROW, strict=True)], schema=FOLDED_ARROW)

        for batch in batches:
            for p, kind, seq, body, key_column, *named in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if p != part:
                    ended()
                    part, keys, rows = p, {}, None
                said = json.loads(body)
                if kind == 0:
                    keys[said["column"], said["value"]] = bool(said.get("many"))
                    continue
                rows = rows or Rows(keys, [k for k, much in keys.items() if much])
                if kind == 1:
                    rows.add(seq, said)
                    continue
                same = not (sha256 and said.get("source_sha256")) or said["source_sha256"] == sha256
                why = rows.apply(said, key_column, same)
                if any(isinstance(r, str) for r in _refs(said)):
                    said.setdefault("key_column", key_column)
                if sha256:
                    said.setdefault("source_sha256", sha256)
                out.append((2, seq, why, json.dumps(said), *named))
            yield batch_of()
            out.clear()
        ended()
        yield batch_of()

    return run


def applied(sheet: DataFrame, outcome: Outcome) -> DataFrame:
    """The sheet with patched cells and without dropped rows; row numbers stay."""
    joined = sheet.join(outcome.dropped, ROW, "left_anti").join(outcome.patches, ROW, "left")
    columns = [r[0] for r in outcome.patches.select(F.explode(F.map_keys("patch"))).distinct().collect()]  # columns of the sheet at most
    new = {c: F.coalesce(F.try_element_at("patch", F.lit(c)), F.col(f"`{c}`").cast("string")) for c in columns if c in sheet.columns}
    return joined.withColumns(new).select(*(F.col(f"`{c}`") for c in sheet.columns))


@dataclass(frozen=True)
class Worked:
    """sheet: corrected; verdicts by id; corrections: the list with its active ones completed; key: the column in force at the end."""

    sheet: DataFrame
    verdicts: dict[str, dict]
    corrections: list[dict]
    key: str


def worked(sheet: DataFrame, key: str, corrections: list[dict], sha256: str = "") -> Worked:
    """A list of corrections applied, and the list as it is to be recorded."""
    if not active(corrections):
        return Worked(sheet, {}, corrections, key)
    outcome = fold(sheet, key, as_table(sheet.sparkSession, numbered_ids(corrections)), sha256, apart=False)
    rows = outcome.verdicts.orderBy("seq").collect()  # one for each of the list
    verdicts = {r["id"]: {"applicable": r["applicable"], "invalid": r["invalid"], "why": r["why"]} for r in rows}
    return Worked(applied(sheet, outcome), verdicts, merged(corrections, [json.loads(r["completed"]) | {"id": r["id"]} for r in rows]), outcome.key)


def prepared(sheet: DataFrame, key: str, corrections: list[dict], same_source: bool = True) -> tuple[DataFrame, dict[str, dict]]:
    """(the corrected sheet, verdicts by id). same_source False: references by row number don't hold."""
    done = worked(sheet, key, corrections if same_source else [c | {"source_sha256": "another"} for c in corrections], "" if same_source else "this")
    return done.sheet, done.verdicts


def numbered_ids(corrections: list[dict]) -> list[dict]:
    """Those in force, where one without id gets the next free of c1, c2, ..."""
    taken, n, out = {text(c.get("id")) for c in active(corrections)}, 0, []
    for c in active(corrections):
        if not text(c.get("id")):
            n += 1
            while f"c{n}" in taken:
                n += 1
            c = c | {"id": f"c{n}"}
        out.append(c)
    return out


def conflict_status(fresh: DataFrame, previous: DataFrame, answers: DataFrame, hash_changed: bool) -> DataFrame:
    """conflict_key, severity, status, event of fresh and vanished conflicts.

    fresh: conflict_key, severity. previous: conflict_key, severity, status. answers: conflict_key, action, applicable.
    A dismissal waives; without answers a conflict is open; an answer that can't be applied makes it stale; else it is
    corrected. What is no longer detected is resolved, or stale if it has answers and the source has changed.
    event is the history's next entry: detected at first sight, else a status that is new.
    """
    said = answers.groupBy("conflict_key").agg(F.bool_or(F.col("action") == "dismiss_conflict").alias("waived"), F.bool_and("applicable").alias("works"))
    now = fresh.select("conflict_key", F.col("severity").alias("s"), F.lit(True).alias("here"))
    before = previous.select("conflict_key", F.col("severity").alias("ps"), F.col("status").alias("was"), F.lit(True).alias("known"))
    both = now.join(before, "conflict_key", "full_outer").join(said, "conflict_key", "left")
    live = F.when(F.col("waived"), "waived").when(F.col("works").isNull(), "open").when(~F.col("works"), "stale").otherwise("corrected")
    gone = F.when(F.col("works").isNotNull() & F.lit(hash_changed), "stale").otherwise("resolved")
    both = both.withColumn("status", F.when(F.col("here"), live).otherwise(gone))
    changed = ~F.col("status").eqNullSafe(F.col("was"))
    event = F.when(F.col("known").isNull() & (F.col("status") == "open"), "detected").when(F.col("known").isNull(), F.concat(F.lit("detected,"), "status")).when(changed, F.col("status"))
    return both.select("conflict_key", F.coalesce("s", "ps").alias("severity"), "status", event.alias("event"))


def blocking(statuses: DataFrame) -> DataFrame:
    """Conflicts that stop an import: errors that are open or stale; no status is open."""
    return statuses.filter((F.col("severity") == "error") & F.coalesce("status", F.lit("open")).isin("open", "stale"))
