"""What several operators share: reading tables, slicing Arrow text, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def keyed(docs: DataFrame, own: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """docs with row_key, a long of its own for each row, and whether that is the column `own`.

    It is where `own` tells rows apart; else rows are numbered in its order, those without one last.
    """
    if not docs.groupBy(own).count().filter(f"count > 1 or {own} is null").limit(1).count():
        return docs.withColumn("row_key", F.col(own).cast("long")), True
    order = [F.col(own).asc_nulls_last(), F.xxhash64(text)]  # the hash parts the rows of one id
    return written(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_key", F.monotonically_increasing_id()), "keyed"), False


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on from task to task, and its peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What this Python worker keeps from task to task: one thing at most, see `resident`.
_KEPT: dict[tuple, object] = {}


def resident(name: tuple, make: Callable[[], object]) -> object:
    """make()'s value, kept in this Python worker until a task begins that names another."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def keep_only(name: tuple | None) -> None:
    for other in [k for k in _KEPT if k != name]:
        del _KEPT[other]
    give_back()


Batches = Iterator[pa.RecordBatch]
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(function: Callable[[Batches], Batches], schema: str, most: int = 8 << 20, keeps: tuple | None = None) -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform: mapInArrow with batches of at most about `most` bytes, giving freed memory back.

    keeps: the name of what function keeps by `resident`; all else that earlier tasks kept in the worker goes first.
    A session with a larger limit is set to `most`: batches of long texts are held several times, in the JVM too.
    """

    def run(batches: Batches) -> Batches:
        keep_only(keeps)

        def each() -> Batches:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from function(each())
        give_back()

    def apply(df: DataFrame) -> DataFrame:
        limit = int(str(df.sparkSession.conf.get(BATCH)).rstrip("b"))
        if not 0 < limit <= most:
            df.sparkSession.conf.set(BATCH, most)
        return df.mapInArrow(run, schema)

    return apply


def slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with at most max_bytes of text each, or a single longer text."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + max_bytes, side="right")))
        yield start, texts.slice(start, end - start)
        start = end


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, word numbers, distinct words): text i has word numbers[offsets[i]:offsets[i + 1]].

    Cut at ASCII white space; there are no empty words.
    """
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(parts), dtype=np.int64))))
    coded = flat.dictionary_encode()
    numbers, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    blank = np.asarray(pc.equal(pc.binary_length(distinct), 0)) if len(distinct) else np.zeros(0, bool)
    if blank.any():
        keep = ~blank[numbers]
        counts = np.concatenate(([0], np.cumsum(keep)))
        offsets, numbers = counts[offsets], numbers[keep]
    return offsets, numbers, distinct


def groups_of(batches: Batches, keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            values = c.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != columns[k][0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def starts_of(columns: list[np.ndarray]) -> np.ndarray:
    """Where each group begins, and the end."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change), [len(columns[0])]))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
