"""Operator 1, best-fit packing: a configuration linear program over the length histogram.

The program has one variable for each way of filling a sequence (a configuration) and one
covering row for each length class. Multiplicative weights hold the prices of the classes; the
configuration to raise next comes from a knapsack dynamic program over those prices. Rounding
realises the configurations with exact lengths, whole numbers of sequences first, then one of each configuration
with a large fraction left; each sequence is closed with the best-fitting length in stock. What the rounding leaves is
packed longest first with the same best fit. The prices of the program with lengths rounded down bound the number of
sequences from below (`least_sequences`).

The histogram has at most `capacity` rows whatever the input, so the program runs on the driver.
Every step of the rounding uses up a length or a configuration, so the plan that goes back to
the executors has at most (lengths + configurations) steps, too.

Defined cases: a null text is empty; an empty text is the single closing id; rows are packed once each, also where doc_ids
repeat or are null; a very long text is held alone; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import in_batches, mix64, resident, slices, spread, text_of, words_of
from tabulon.sources.shared import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of words by a `tokenizers` file; the vocabulary splits at white space, so words are independent.

    Keeps the ids of words from slice to slice, found by a 128-bit hash, in at most `room` bytes.
    """

    def __init__(self, path: str, room: int = 24 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.values = [mix64(np.arange(1 + k, 257 + k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (0, 256)]

    def _hashes(self, words: pa.Array) -> list[np.ndarray]:
        sizes = np.asarray(pc.binary_length(words), dtype=np.int64)
        data = np.frombuffer(words.cast(pa.binary()).buffers()[2] or b"", np.uint8)[: int(sizes.sum())]
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        power = np.full(int(sizes.max()), 0x5851F42D4C957F2D, np.uint64)
        power[0] = 1
        power = np.cumprod(power)[place]
        return [mix64(np.add.reduceat(v[data] * power, starts)) for v in self.values]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        offsets, numbers, distinct = words_of(texts)
        if not len(numbers):
            return np.zeros(0, np.uint32), offsets
        used = np.unique(numbers)
        if len(used) < len(distinct):
            numbers, distinct = np.searchsorted(used, numbers), distinct.take(pa.array(used))
        # capitals are lowered by the vocabulary's own normaliser, but for its special tokens, which come first
        plain = pc.if_else(pc.match_substring(distinct, "<|"), distinct, pc.ascii_lower(distinct)).dictionary_encode()
        numbers, distinct = plain.indices.to_numpy().astype(np.int64)[numbers], pa.concat_arrays([plain.dictionary])
        key, check = self._hashes(distinct)
        n, start = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        old = (self.keys[place] == key) & (self.checks[place] == check) if len(self.keys) else np.zeros(len(key), bool)
        n[old], start[old] = self.sizes[place[old]], self.starts[place[old]]
        pool, new = self.ids, np.flatnonzero(~old)
        if len(new):
            found: list[list[int]] = []
            for at in range(0, len(new), 8192):  # an encoding takes far more room than its ids
                found += [e.ids for e in self.tokenizer.encode_batch_fast(distinct.take(pa.array(new[at : at + 8192])).to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
            n[new], start[new] = sizes, self.used + np.cumsum(sizes) - sizes
            need = self.used + len(ids)
            if len(self.ids) < need:
                self.ids = np.concatenate((self.ids, np.zeros(max(need - len(self.ids), len(self.ids) // 4), np.uint32)))
            pool = self.ids
            pool[self.used : need] = ids
            if 24 * (len(self.keys) + len(new)) + 4 * need <= self.room:
                self.used = need
                order = np.argsort(key[new], kind="stable")
                at = np.searchsorted(self.keys, key[new][order])
                self.keys, self.checks = np.insert(self.keys, at, key[new][order]), np.insert(self.checks, at, check[new][order])
                self.starts, self.sizes = np.insert(self.starts, at, start[new][order].astype(np.int32)), np.insert(self.sizes, at, sizes[order].astype(np.int32))
        each = n[numbers]
        total = np.concatenate(([0], np.cumsum(each)))
        return pool[spread(start[numbers], each)], total[offsets]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, slice_bytes: int = 1 << 20) -> DataFrame:
    """The pieces of each document: its ids, then end_id, cut only where longer than capacity."""

    def cut(batches):
        encode = resident(("words", tokenizer_path), lambda: WordIds(tokenizer_path))  # later tasks know the words of earlier ones
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for first, texts in slices(batch.column(1), slice_bytes):
                ids, offsets = encode(texts)
                ids = ids.astype("<u4", copy=False)
                for k in range(len(texts)):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        out.append((doc_ids[first + k], piece, at, len(part), zlib.crc32(part.tobytes())))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(5)], names=list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).transform(in_batches(cut, PIECES, keeps=("words", tokenizer_path)))


def program(histogram: np.ndarray, capacity: int, classes: int = 256, rounds: int = 1500, rate: float = 0.3, relaxed: bool = False) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """(the linear program's solution: (classes of the items, number of sequences), its lower bound), by multiplicative weights.

    histogram[l]: pieces of length l. A class is a length in units of capacity / classes, to the nearest; relaxed: rounded
    down, so that every true packing is one of the program's and prices bound its sequences from below: no configuration is
    worth more than the best one, so all needs together, at those prices, take at least their worth divided by that.
    """
    unit = capacity / classes
    lengths = np.flatnonzero(histogram)
    of = (lengths / unit).astype(int) if relaxed else np.clip(np.rint(lengths / unit).astype(int), 1, classes)
    need = np.bincount(of, weights=histogram[lengths], minlength=classes + 1)
    need[0] = 0
    present = need > 0
    if not present.any():
        return [], 0.0
    weight, times, bound = np.where(present, 1.0, 0.0), {}, 0.0
    for _ in range(rounds):
        price = np.where(present, weight / np.maximum(need, 1), -1.0)
        best, choice = np.zeros(classes + 1), np.zeros(classes + 1, int)
        for room in range(1, classes + 1):  # the knapsack: most price in so much room
            value = price[1 : room + 1] + best[room - 1 :: -1][:room]
            k = int(value.argmax())
            best[room], choice[room] = (value[k], k + 1) if value[k] > best[room - 1] else (best[room - 1], 0)
        bound = max(bound, float(weight.sum() / best[classes]))
        used, room = np.zeros(classes + 1, int), classes
        while room > 0:
            if choice[room]:
                used[choice[room]] += 1
                room -= choice[room]
            else:
                room -= 1
        inside = used > 0
        step = float((need[inside] / used[inside]).min())
        weight[inside] *= np.exp(-rate * step * used[inside] / need[inside])
        weight /= weight.max()
        items = tuple(int(c) for c in np.repeat(np.arange(classes + 1), used)[::-1])
        times[items] = times.get(items, 0.0) + step
    volume = sum(sum(items) * x for items, x in times.items())
    scale = float((need * np.arange(classes + 1)).sum()) / volume
    return sorted(((items, x * scale) for items, x in times.items()), key=lambda p: (-p[1], p[0])), bound


def configurations(histogram: np.ndarray, capacity: int, classes: int = 256, rounds: int = 1500) -> list[tuple[tuple[int, ...], float]]:
    return program(histogram, capacity, classes, rounds)[0]


def least_sequences(histogram: np.ndarray, capacity: int, classes: int = 256, rounds: int = 300) -> int:
    """No packing has fewer sequences: the relaxed program's bound, or the volume's."""
    bound = program(histogram, capacity, classes, rounds, relaxed=True)[1]
    return max(-int(-(np.arange(len(histogram)) * histogram).sum() // capacity), math.ceil(bound - 1e-6))


def rounded(histogram: np.ndarray, capacity: int, solution: list[tuple[tuple[int, ...], float]], classes: int = 256) -> dict[str, np.ndarray]:
    """The plan: slots (length, rank, count, sequence, offset); pieces rank.. of a length go to sequences sequence..."""
    stock, given = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
    unit, slots, sequence = capacity / classes, [], 0

    def largest(room: int) -> int:
        here = np.flatnonzero(stock[: room + 1] > taken[: room + 1])
        return int(here[-1]) if len(here) else 0

    def emit(items: list[int], most: int) -> int:
        nonlocal sequence
        each = dict.fromkeys(items, 0)
        for length in items:
            each[length] += 1
        count = min([most, *(int(stock[length]) // k for length, k in each.items())])
        offset = 0
        for length in items:
            slots.append((length, int(given[length]), count, sequence, offset))
            given[length] += count
            stock[length] -= count
            offset += length
        sequence += count
        return count

    taken = np.zeros(len(histogram), np.int64)

    def fill(chosen: list[int]) -> list[int]:
        """Best fit: the longest in stock that the room left takes, again and again."""
        room = capacity - sum(chosen)
        while room > 0 and (length := largest(room)):
            chosen.append(length)
            taken[length] += 1
            room -= length
        return chosen

    # whole sequences first, then one of each configuration with a fraction left, the largest first
    parts = sorted(((items, times - int(times)) for items, times in solution), key=lambda p: -p[1])
    for items, left in [*((items, int(times)) for items, times in solution), *((items, 1) for items, part in parts if part > 0.25)]:
        while left > 0:
            taken[:] = 0
            chosen: list[int] = []
            for c in items[:-1]:
                low, high = max(1, int(np.ceil((c - 0.5) * unit))), min(capacity, int((c + 0.5) * unit))
                near = stock[low : high + 1] - taken[low : high + 1]
                k = int(near.argmax()) if len(near) else 0
                if not len(near) or near[k] <= 0 or sum(chosen) + low + k > capacity:
                    break
                chosen.append(low + k)
                taken[low + k] += 1
            else:
                if not (chosen := fill(chosen)):
                    break
                left -= emit(chosen, left)
                continue
            break  # a class ran out: the rest of this configuration goes to the best fit below
    while stock.any():
        taken[:] = 0
        emit(fill([]), 1 << 62)
    columns = np.array(slots, np.int64).reshape(-1, 5)
    columns = columns[columns[:, 2] > 0]
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return dict(zip(("length", "rank", "count", "sequence", "offset"), columns.T, strict=True))


def pack(pieces: DataFrame, capacity: int = 4096, buckets: int = 128) -> DataFrame:
    """pieces plus sequence_id and offset: gapless sequences of at most capacity ids; lower_bound: no packing has fewer sequences.

    pieces needs doc_id, piece and length, and should be a stored table, since it is read twice. Each
    length is ranked in `buckets` parts, so that one common length is not one task.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    parts = pieces.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").agg(F.sum("__n").alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(rounded(histogram, capacity, configurations(histogram, capacity)))
    least = least_sequences(histogram, capacity)
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("length", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece")) - 1

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        slots = plan.value
        key = slots["length"] * (1 << 48) + slots["rank"]
        at = np.searchsorted(key, length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": slots["sequence"][at] + rank.to_numpy() - slots["rank"][at], "offset": slots["offset"][at]})

    ranked = pieces.withColumn("__rank", rank).join(parts, ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    placed_at = ranked.withColumn("__at", placed(F.col("length"), F.col("__rank").cast("long")))
    return placed_at.select(*(c for c in pieces.columns if not c.startswith("__")), "__at.sequence_id", "__at.offset", F.lit(least).cast("long").alias("lower_bound"))


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Documents (doc_id, text) tokenised, cut and packed; one row for each piece."""
    return pack(written(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
