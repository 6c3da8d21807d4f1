"""Intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors.

All tables of a session lie in one folder under spark.checkpoint.dir, which is deleted when the session's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "tabulon.session.folder"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder; on a cluster that is an error,
    since executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tabulon-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def session_folder(spark: SparkSession) -> str:
    """This session's own folder. It must exist when its deletion is registered: missing paths are passed over."""
    top, known = shared_dir(spark), spark.conf.get(FOLDER, None)
    if known and known.startswith(top + "/"):
        return known
    made = f"{top}/tabulon-{uuid.uuid4().hex}"
    files, path = hadoop(spark, made)
    files.mkdirs(path)
    files.deleteOnExit(path)
    spark.conf.set(FOLDER, made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path, not yet there."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    files, of = hadoop(spark, path)
    files.delete(of, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, new_folder(df.sparkSession, name))


def spread_out(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a small file is one partition, and heavy work on it one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else written(df.repartition(cores), "spread")
