"""Run logs as streams of JSON lines, and their folds kept up to date.

The folds over logs are sums, counts and greatest places, so Spark keeps them by key as lines arrive; late lines find
their place by seq like all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.operators.journal import IDENTITY, log_counts, requirement_state


def follow(spark: SparkSession, folder: str, schema: str, files_each: int | None = None) -> DataFrame:
    """A stream of the log files that arrive in folder; lines that don't parse are left out. files_each: files a batch."""
    read = spark.readStream.schema(f"{schema}, _corrupt_record string")
    read = (read.option("maxFilesPerTrigger", files_each) if files_each else read).json(folder)
    return read.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def running_counts(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """status, count so far, in the memory table `name`; stops when what has arrived is counted."""
    return log_counts(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running(log: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps fold(log) in path: each batch adds the rows of the keys that it changed. Stops when what has arrived is folded.

    A batch that is run again after a failure replaces its own rows.
    """
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return fold(log).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: tuple[str, ...]) -> DataFrame:
    """The newest row of each key that `running` has written."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*key, "batch")]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("now"))
    return newest.select(*key, "now.*")


def running_requirements(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The state of each requirement as the log grows."""
    return running(log, requirement_state, path, checkpoint)


def requirements(spark: SparkSession, path: str) -> DataFrame:
    return current(spark, path, IDENTITY)
