"""Changes to a large Parquet table that rewrite only the files that hold changed rows.

A table is a folder with data files and lists of those that count: `_versions/<number>` names the files of a version,
one a line. A list appears whole or not at all and never changes, so readers see one version or the next, and of two
writers that start from one version the second is refused. Files are Spark's; this only says which of them count.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.records import before_image, delete_records, update_records
from tabulon.sources.shared import hadoop, removed

LISTS = "_versions"


@dataclass(frozen=True)
class Change:
    """version: the new one; rewritten and kept: numbers of the old one's files."""

    version: int
    rewritten: int
    kept: int


def version_of(spark: SparkSession, path: str) -> int:
    """The newest version; FileNotFoundError without one."""
    files, folder = hadoop(spark, f"{path}/{LISTS}")
    found = [int(n) for s in (files.listStatus(folder) if files.exists(folder) else []) if (n := s.getPath().getName()).isdigit()]
    if not found:
        raise FileNotFoundError(f"{path} has no version")
    return max(found)


def files_of(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    number = version_of(spark, path) if version is None else version
    return [r[0] for r in spark.read.text(f"{path}/{LISTS}/{number:012d}").collect()]  # one row a file


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or an earlier one as long as its files are there."""
    return spark.read.option("basePath", path).parquet(*(f"{path}/{f}" for f in files_of(spark, path, version)))


def _added(spark: SparkSession, df: DataFrame, path: str) -> list[str]:
    """Writes df in a folder of its own; its files, relative to path."""
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    files, folder = hadoop(spark, f"{path}/{name}")
    return [f"{name}/{s.getPath().getName()}" for s in files.listStatus(folder) if s.getPath().getName().endswith(".parquet")]


def _committed(spark: SparkSession, path: str, version: int, names: list[str]) -> None:
    """The list is written aside and renamed, which fails if the version is there by now."""
    aside = f"{path}/{LISTS}/.{uuid.uuid4().hex}"
    files, target = hadoop(spark, f"{path}/{LISTS}/{version:012d}")
    _, source = hadoop(spark, aside)
    out = files.create(source)
    out.write(bytearray("".join(f"{n}\n" for n in sorted(names)).encode()))
    out.close()
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, False)
        raise RuntimeError(f"version {version} of {path} was made by another writer")


def create(df: DataFrame, path: str) -> Change:
    spark = df.sparkSession
    _committed(spark, path, 1, _added(spark, df, path))
    return Change(1, 0, 0)


def append(df: DataFrame, path: str) -> Change:
    spark, version = df.sparkSession, version_of(df.sparkSession, path)
    old = files_of(spark, path, version)
    _committed(spark, path, version + 1, [*old, *_added(spark, df, path)])
    return Change(version + 1, 0, len(old))


def _changed(spark: SparkSession, path: str, keys: DataFrame, key: str, change) -> Change:
    version = version_of(spark, path)
    old = files_of(spark, path, version)
    place = F.col("_metadata.file_path")
    hit = read(spark, path, version).select(key, place.alias("__file")).join(keys.select(key).distinct(), key, "left_semi")
    named = {"/".join(r[0].split("/")[-2:]) for r in hit.select("__file").distinct().collect()}  # one row a file
    touched = [f for f in old if f in named]
    if not touched:
        return Change(version, 0, len(old))
    rows = spark.read.option("basePath", path).parquet(*(f"{path}/{f}" for f in touched))
    _committed(spark, path, version + 1, [*(f for f in old if f not in named), *_added(spark, change(rows), path)])
    return Change(version + 1, len(touched), len(old) - len(touched))


def update(spark: SparkSession, path: str, patch: DataFrame, key: str) -> Change:
    """Replaces the columns of patch in the rows with its keys."""
    return _changed(spark, path, patch, key, lambda rows: update_records(rows, patch, key))


def delete(spark: SparkSession, path: str, keys: DataFrame, key: str) -> Change:
    return _changed(spark, path, keys, key, lambda rows: delete_records(rows, keys, key))


def before(spark: SparkSession, path: str, patch: DataFrame, key: str, version: int | None = None) -> DataFrame:
    """What an update overwrites, or has overwritten since a version."""
    return before_image(read(spark, path, version), patch, key)


def cleared(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes the lists of all but the newest versions, and the data files that none of the others names; how many files."""
    newest = version_of(spark, path)
    files, folder = hadoop(spark, f"{path}/{LISTS}")
    numbers = sorted(int(n) for s in files.listStatus(folder) if (n := s.getPath().getName()).isdigit())
    old, left = [n for n in numbers if n <= newest - keep], [n for n in numbers if n > newest - keep]
    wanted = {f for n in left for f in files_of(spark, path, n)}
    gone = sorted({f for n in old for f in files_of(spark, path, n)} - wanted)
    for f in gone:
        removed(spark, f"{path}/{f}")
    for n in old:
        removed(spark, f"{path}/{LISTS}/{n:012d}")
    return len(gone)
