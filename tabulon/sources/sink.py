"""Payloads written to a target, with one outcome for each row.

Rows are sent by the tasks that hold them; outcomes are a table that Spark's writer commits task by task. A row that
fails is an outcome, not an error of its task. A task that is run again sends its rows under the same keys, and the
target makes a row once for each key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.text import strip
from tabulon.operators.profile import ROW
from tabulon.sources.paged import Site
from tabulon.sources.records import load_outcome
from tabulon.sources.shared import written

OUTCOME = f"{ROW} long, key string, name string, ok boolean, skipped boolean, error string"
SENT = pa.schema([(ROW, pa.int64()), ("key", pa.string()), ("name", pa.string()), ("ok", pa.bool_()), ("skipped", pa.bool_()), ("error", pa.string())])


def sent(payloads: DataFrame, key: str, send: Callable[[dict, str], str], run: str, existing: DataFrame | None = None) -> DataFrame:
    """OUTCOME of each payload. send(row, once): makes the row and gives its name, or raises; once is the same in every attempt of a run.

    existing: rows whose key it has by now are skipped.
    """
    shown = strip(F.col(f"`{key}`").cast("string"))
    rows = payloads.select(ROW, shown.alias("key"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in payloads.columns if c != ROW))).alias("payload"))
    there = None
    if existing is not None:
        there = rows.join(existing.select(strip(F.col(f"`{key}`").cast("string")).alias("key")).distinct(), "key", "left_semi").filter("key <> ''")
        rows = rows.join(there.select(ROW), ROW, "left_anti")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, shown, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out.append({ROW: number, "key": shown, "name": send(json.loads(payload), f"{run}:{number}:{shown or ''}"), "ok": True, "skipped": False})
                except Exception as e:  # noqa: BLE001  whatever the target says about a row is that row's outcome
                    out.append({ROW: number, "key": shown, "name": shown, "ok": False, "skipped": False, "error": str(e) or type(e).__name__})
            yield from pa.Table.from_pylist(out, schema=SENT).to_batches()

    done = written(rows.mapInArrow(each, OUTCOME), "outcomes")
    if there is None:
        return done
    return done.unionByName(there.select(ROW, "key", F.col("key").alias("name"), F.lit(True).alias("ok"), F.lit(True).alias("skipped"), F.lit(None).cast("string").alias("error")))


def sent_to_site(payloads: DataFrame, key: str, site: Site, table: str, run: str, existing: DataFrame | None = None) -> DataFrame:
    return sent(payloads, key, lambda row, once: str(site.insert(table, row, once)["name"]), run, existing)


def unsent(payloads: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What a further attempt has to send."""
    return payloads.join(outcomes.filter("ok").select(ROW), ROW, "left_anti")


def stored_in(payloads: DataFrame, key: str, path: str, valid: Column | None = None, why: str = "not valid") -> DataFrame:
    """OUTCOME of each payload after those that are valid and new were added to the table in path.

    Of several payloads with one key the first is taken. Nothing of a failed write is seen, and a write that is repeated
    finds its rows there.
    """
    spark = payloads.sparkSession
    fields = [f for f in payloads.schema.fields if f.name != ROW]
    spark.createDataFrame([], T.StructType(fields)).write.mode("append").parquet(path)
    there = spark.read.schema(T.StructType(fields)).parquet(path)
    judged = load_outcome(payloads, key, there, valid, why)
    first = judged.filter("ok").groupBy(key).agg(F.min(ROW).alias("__first"))
    judged = judged.join(first, key, "left").withColumn("again", F.col("ok") & (F.col(ROW) > F.col("__first")))
    judged = written(judged.select(*payloads.columns, (F.col("ok") & ~F.col("again")).alias("ok"), (F.col("skipped") | F.col("again")).alias("skipped"), "error"), "outcomes")
    judged.filter("ok").select(*(f.name for f in fields)).write.mode("append").parquet(path)
    shown = F.col(f"`{key}`").cast("string")
    return judged.select(F.col(ROW), shown.alias("key"), shown.alias("name"), (F.col("ok") | F.col("skipped")).alias("ok"), "skipped", "error")


def import_outcomes(log: DataFrame) -> DataFrame:
    """__row, key, status, message from the log of a bulk import: row_indexes and messages (JSON), docname, success.

    The first of a record's rows counts. Messages are objects with a message; what doesn't parse is shown as it is.
    A success without a name and a failure without messages say nothing.
    """
    rows = F.from_json("row_indexes", "array<bigint>")
    texts = F.transform(F.from_json("messages", "array<map<string,string>>"), lambda m: F.coalesce(m["message"], F.lit("")))
    readable = F.from_json("messages", "array<map<string,string>>").isNotNull() & F.forall(F.from_json("messages", "array<map<string,string>>"), lambda m: m.isNotNull())
    won = F.coalesce(F.col("success").cast("boolean"), F.lit(False))
    named, said = F.coalesce("docname", F.lit("")), F.coalesce("messages", F.lit(""))
    shown = log.filter((won & (named != "")) | (~won & (said != "")))
    message = F.when(~won, F.when(readable, F.array_join(texts, "; ")).otherwise(F.col("messages")))
    return shown.select(F.try_element_at(rows, F.lit(1)).alias(ROW), named.alias("key"), F.when(won, "created").otherwise("failed").alias("status"), message.alias("message"))
