"""Sheets from files: every column text, blank rows gone, rows numbered from 2 by file name, then by place."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from tabulon.sources.split_csv import read_split


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .csv, .xlsx or .xlsm; else ValueError."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        return read_split(spark, path)
    if suffix in (".xlsx", ".xlsm"):
        from tabulon.sources.xlsx import read_xlsx

        return read_xlsx(spark, path)
    raise ValueError(f"no reader for {suffix or 'a file without suffix'}")
