"""Operator 12, periodic runs: every stretch of a text whose words repeat with a period, and the text without the repeats.

A run is a stretch of consecutive words with smallest period q, at least max(least, 2 * q) words long, that no
neighbouring word extends. For each period p the grid asks, at words jp and (j+1)p, how far the two places agree
forward and backward: a run of 2p words holds such a pair of the grid, and the two lengths give its ends. Lengths
come from a suffix array of the words and one of the reversed words, the lengths that neighbours in them share,
and a table of range minima. The sum of the grid over all p is n log n.

Two exact filters go before it. A run has a string of least / 2 words that occurs again in its text, so texts
without one have no runs and get no suffix array; and a pair of the grid whose own words differ lies in no run.

Each text is looked at by itself, several at a time in one array, so nothing is shuffled and hot keys don't exist.

Defined cases: a null text is empty and has no runs; equal rows are judged each; an empty table gives no rows; only
the named columns are kept. Words are cut at ASCII white space and compared as they are. A very long text is held
alone, at some 100 bytes a word for each level of the range minima (about 3 KB a word for a million words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import in_batches, mix64, slices, spread, words_of
from tabulon.sources.shared import spread_out

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def with_repeats(numbers: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Which texts hold a string of `size` words twice; by hash, so a text may be named wrongly but none is missed."""
    sizes, found = np.diff(offsets), np.zeros(len(offsets) - 1, bool)
    at = spread(offsets[:-1], np.maximum(sizes - size + 1, 0))
    if not len(at):
        return found
    mixed, strings = mix64(numbers), np.zeros(len(at), np.uint64)
    for i in range(size):
        strings = strings * np.uint64(0x9E3779B97F4A7C15) + mixed[at + i]
    texts = np.repeat(np.arange(len(sizes), dtype=np.uint64), np.maximum(sizes - size + 1, 0))
    keys = np.sort(texts << np.uint64(40) | mix64(strings) >> np.uint64(24))
    found[(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(40)).astype(np.int64)] = True
    return found


class SharedLengths:
    """How many symbols the strings from two places have in common; symbols end with a value of its own for each text."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        rank, step = (np.cumsum(counts) - counts)[inverse].astype(np.int32), 1  # rank: how many suffixes have a smaller beginning
        levels, open_ = [rank], np.flatnonzero(counts[inverse] > 1)
        while len(open_):  # suffixes that share their first `step` symbols with another are sorted by the next `step`
            key = rank[open_].astype(np.int64) * (n + 1) + rank[open_ + step]
            order = np.argsort(key)
            key, open_ = key[order], open_[order]
            new, group = np.diff(key, prepend=-1) != 0, key // (n + 1)
            starts = np.flatnonzero(new)
            head = np.flatnonzero(np.diff(group, prepend=-1))
            alike = np.diff(np.append(starts, len(key)))
            rank = rank.copy()
            rank[open_] = group + np.repeat(starts, alike) - np.repeat(head, np.diff(np.append(head, len(key))))
            levels.append(rank)
            open_, step = open_[np.repeat(alike, alike) > 1], step * 2
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        left, right, shared = suffixes[:-1].copy(), suffixes[1:].copy(), np.zeros(max(n - 1, 0), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][left] == levels[k][right]
            left, right = left + (same << k), right + (same << k)
            shared += (same << k).astype(np.int32)
        del levels
        self.least = [shared]  # least[k][i]: the least of shared[i : i + 2 ** k]
        while (half := 1 << (len(self.least) - 1)) * 2 <= len(shared):
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
        self.logs = np.frexp(np.arange(n + 1, dtype=np.float64))[1] - 1

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different places a and b."""
        low, high = np.minimum(self.rank[a], self.rank[b]).astype(np.int64), np.maximum(self.rank[a], self.rank[b]).astype(np.int64)
        level = self.logs[high - low]
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out


def grid(sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, p, j) of all pairs of the grid, about `most` at a time: p up to half a text's words, (j + 1) * p a word of it."""
    periods = sizes // 2
    texts, p = np.repeat(np.arange(len(sizes)), periods), spread(np.ones(len(sizes), np.int64), periods)
    pairs = (sizes[texts] - 1) // p
    ends, start = np.cumsum(pairs), 0
    while start < len(p):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        n = pairs[start:end]
        yield np.repeat(texts[start:end], n), np.repeat(p[start:end], n), spread(np.zeros(end - start, np.int64), n)
        start = end


def runs_of(numbers: np.ndarray, offsets: np.ndarray, least: int, most: int = 1 << 21) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted. Text i has the words numbers[offsets[i]:offsets[i + 1]]."""
    sizes = np.diff(offsets)
    count = len(sizes)
    if not len(numbers):
        return np.zeros((0, 4), np.int64)
    base = offsets[:-1] + np.arange(count)  # each text is followed by a symbol of its own
    symbols = np.empty(len(numbers) + count, np.int64)
    place = np.repeat(base - offsets[:-1], sizes) + np.arange(len(numbers))
    symbols[place] = numbers + count
    symbols[base + sizes] = np.arange(count)
    near = [(texts[same], p[same], j[same]) for texts, p, j in grid(sizes, most) if len(same := np.flatnonzero(symbols[(at := base[texts] + j * p)] == symbols[at + p]))]
    if not near:
        return np.zeros((0, 4), np.int64)
    text, p, j = (np.concatenate(x) for x in zip(*near, strict=True))
    at = base[text] + j * p
    forward = SharedLengths(symbols).of(at, at + p)
    backward = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(j)  # before word 0 there is nothing
    mirror = np.empty_like(symbols)  # each text reversed, its own symbol still last
    mirror[np.repeat(base + sizes - 1, sizes) - (place - np.repeat(base, sizes))] = symbols[place]
    mirror[base + sizes] = symbols[base + sizes]
    back = base[text] + sizes[text] - j * p  # where the word before jp lies in the mirror
    if len(inner):
        backward[inner] = SharedLengths(mirror).of(back[inner], (back - p)[inner])
    start, length = j * p - backward, p + forward + backward
    run = length >= np.maximum(least, 2 * p)
    found = np.stack([text[run], start[run], length[run], p[run]], axis=1)
    found = found[np.lexsort(found.T[::-1])]  # of one stretch the smallest period comes first; its multiples have the same ends
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def kept_words(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds behind its first period."""
    change = np.zeros(int(offsets[-1]) + 1, np.int64)
    at = offsets[runs[:, 0]] + runs[:, 1]
    np.add.at(change, at + runs[:, 3], 1)
    np.add.at(change, at + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), least: int = 12, slice_bytes: int = 1 << 20) -> DataFrame:
    """The columns keep, n_words, runs (start, length and period in words, by start, then period) and collapsed: the words without repeats, joined by spaces."""
    kept_fields = docs.select(*keep).schema.fields if keep else []

    def find(batches):
        for batch in batches:
            for first, texts in slices(batch.column(0), slice_bytes):
                offsets, numbers, distinct = words_of(texts.fill_null(""))
                repeat = with_repeats(numbers, offsets, max(1, least // 2))
                some = np.flatnonzero(repeat)
                sizes = np.diff(offsets)
                inner = np.concatenate(([0], np.cumsum(sizes[some])))
                runs = runs_of(numbers[spread(offsets[:-1][some], sizes[some])], inner, least)
                runs[:, 0] = some[runs[:, 0]]
                stay = kept_words(runs, offsets)
                ends = np.concatenate(([0], np.cumsum(stay)))[offsets]
                words = distinct.take(pa.array(numbers[stay]))
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.cast(pa.string())), " ")
                each = pa.array(np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)), pa.int32())
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)], names=["start", "length", "period"])
                columns = [batch.column(1 + k).slice(first, len(texts)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(each, structs), collapsed], names=[*keep, "n_words", "runs", "collapsed"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields), "n_words bigint", f"runs {RUNS}", "collapsed string"])
    return spread_out(docs.select(text, *keep)).transform(in_batches(find, schema))


def run_digest(docs: DataFrame) -> DataFrame:
    """Of each document, with the repeated tails that `with_repeated_tails` gives some: its runs and the text without repeats, as digests."""
    found = periodic_runs(with_repeated_tails(docs.select("doc_id", "text")), keep=("doc_id",))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("under"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.before")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.under")).alias("period"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.withColumn("exponent_milli", F.expr("1000 * length div period"))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """docs where the words of a tenth of the texts, chosen by the hash h of doc_id, repeat from word a on with a period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    docs = docs.withColumn("words", words).withColumn("n", F.size("words").cast("long"))
    docs = docs.withColumn("g", F.floor(h / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = "slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a) div p) + 1)), 1, int(n - a))"
    edited = F.expr(f"array_join(concat(slice(words, 1, int(a)), {tail}), ' ')")
    return docs.withColumn("text", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text"))).drop("words", "n", "g", "a", "p")
