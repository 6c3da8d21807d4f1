"""Operator 4, suffix-array dedup: removes every byte of a string of `span` bytes that also starts elsewhere.

1. Anchors. Of the k-grams in a window of `span` bytes the one with the smallest hash (the first, if equal)
   is its anchor, so equal windows have equal anchors at equal places. A window can only repeat if its
   anchor's k-gram does; all other windows are left out here, before any text is moved.
2. Contexts. The bytes of an anchor's windows are its context. Contexts are dealt out by the anchor's hash,
   sorted outwards from the anchor, and trimmed to what a neighbour shares; equal ones count once.
3. Suffix arrays. Over the distinct contexts of an anchor a suffix array is built by linear grouping
   (`suffix_array`); a window repeats if the next or previous suffix begins with the same `span` bytes,
   or if its context stands for several. An anchor with a single distinct context needs no order.
4. Spans of repeated windows are gathered by document and merged.

Size. A key stands for the windows that hold its k-gram at one of the offsets low .. high. Where a key has too many
contexts, the offsets are halved: the windows of each half share a longer string around the k-gram, and that string is
the new key, so the contexts part by the bytes next to the anchor. At a single offset the key is the window itself and
all its contexts are equal. Within a task this goes on until a suffix array is over at most `LARGEST` bytes (`repeats`);
keys with more than `many` contexts go the same way in written tables (`crowded_windows`), where equal contexts are
reduced to one row each time, so neither a common line nor a common passage is one task's memory. The method is the
same at every size.

Runs. Where a text repeats itself within `PERIOD` bytes (rules, padding), windows that lie a period apart are equal, so
all windows of the run repeat; it becomes one row, and only the windows of its first period stay as comparators.

Defined cases: a null text is empty; each row is a document of its own, also where doc_ids repeat or are null; texts
shorter than span lose nothing; long texts are searched in overlapping parts, so memory doesn't grow with them; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import groups_of, in_batches, keyed, mix64, slices, spread, starts_of, text_of
from tabulon.sources.shared import written

#: Bytes of text that are looked at together; arrays take some seventy times that.
SLICE = 1 << 18
#: Bytes of distinct contexts in one suffix array, whose Python lists take some 250 times that.
LARGEST = 1 << 17
#: Contexts of a key that one task takes.
MANY = 1 << 16
PERIOD = 64
#: Hashes are compared without their last bits, which hold the place in a slice.
PLACE_BITS = 20
_BASE = 0x5851F42D4C957F2D


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes of text, whose last value must be its smallest and occur once.

    Groups hold suffixes with equal known prefixes; a group's label is the place of its first suffix. They are
    processed in descending order. `before[i]` is the nearest earlier suffix of a lower group; all that
    precede the group by these pointers move up within their groups, those that precede it more often
    in a row higher. In the end a group shares one Lyndon prefix, and the suffixes of a group are in the
    order of the suffixes that follow their Lyndon prefixes, which one ascending pass gives.
    """
    n = len(text)
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    at, start = 0, {}
    size, members, start_of_end = [0] * n, {}, [0] * n
    for c in sorted(counts):
        start[c], size[at], members[at] = at, counts[c], []
        start_of_end[at + counts[c] - 1] = at
        at += counts[c]
    label = [start[c] for c in text]
    for i, g in enumerate(label):
        members[g].append(i)
    before = [-1] * n
    end = n
    while end > 0:
        g = start_of_end[end - 1]
        times: dict[int, int] = {}
        for i in sorted(i for i in members.pop(g) if label[i] == g):
            j = i - 1
            while j >= 0 and label[j] > g:
                j = before[j]
            if j >= 0 and label[j] == g:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, k in times.items():
            levels.setdefault(k, []).append(j)
        for k in sorted(levels, reverse=True):
            parts: dict[int, list[int]] = {}
            for j in levels[k]:
                parts.setdefault(label[j], []).append(j)
            for h, moved in parts.items():
                count = len(moved)
                if count == size[h]:
                    continue
                new = h + size[h] - count
                start_of_end[new + count - 1] = new
                start_of_end[new - 1] = h
                size[h] -= count
                size[new], members[new] = count, moved
                for j in moved:
                    label[j] = new
        end = g
    order, free, placed = [0] * n, label[:], bytearray(n)
    nxt = list(range(n))  # the next free place of each group, by its label
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = free[j]
            order[nxt[g]] = j
            nxt[g] += 1
            placed[j] = 1
            j = before[j]
    return order


class Rolling:
    """Hashes of all k-grams of bytes: differences of prefix sums modulo 2^64."""

    def __init__(self, seed: int = 0) -> None:
        self.values = mix64(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, k: int) -> np.ndarray:
        n = len(data)
        if n < k:
            return np.zeros(0, np.uint64)
        if len(self.powers) < n:
            room = 1 << (n - 1).bit_length()
            self.powers, self.inverse = np.full(room, _BASE, np.uint64), np.full(room, pow(_BASE, -1, 1 << 64), np.uint64)
            self.powers[0] = self.inverse[0] = 1
            self.powers, self.inverse = np.cumprod(self.powers), np.cumprod(self.inverse)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        return mix64((sums[k:] - sums[: n - k + 1]) * self.inverse[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w values in a row."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


ANCHORS = "key long, row_key long, at int, low short, high short, run int"


def parts_of(texts: pa.Array, most: int, overlap: int) -> Iterator[list[tuple[int, int, memoryview]]]:
    """Lots of (row, place in its text, bytes) of about `most` bytes; a longer text comes in parts that overlap."""
    lot: list[tuple[int, int, memoryview]] = []
    held = 0
    for row, text in enumerate(texts):
        data = memoryview(text.as_buffer())
        for at in range(0, max(1, len(data) - overlap), most):
            part = data[at : at + most + overlap]
            if lot and held + len(part) > most:
                yield lot
                lot, held = [], 0
            lot.append((row, at, part))
            held += len(part)
    if lot:
        yield lot


def periodic(data: np.ndarray, begin: int, end: int, place: np.ndarray, keys: np.ndarray, span: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(start, stop, period) of runs in data[begin:end] all of whose windows repeat; place, keys: its anchors in order.

    Equal anchors a period apart tell where to look; the bytes decide.
    """
    step = np.diff(place)
    chained = (keys[1:] == keys[:-1]) & (step > 0) & (step <= PERIOD)
    k, reach = 0, begin
    while k < len(chained):
        if not chained[k]:
            k += 1
            continue
        last = k
        while last + 1 < len(chained) and chained[last + 1] and step[last + 1] == step[k]:
            last += 1
        period, first, stop = int(step[k]), int(place[k]), int(place[last + 1]) + gram
        k = last + 1
        left, right = max(reach, first - span), min(end, stop + span)
        differs = np.flatnonzero(data[left : right - period] != data[left + period : right]) + left
        start = int(differs[differs < first].max(initial=left - 1)) + 1
        stop = int(differs[differs >= first].min(initial=right - period)) + period
        if stop - start >= span + period:
            yield start, stop, period
            reach = stop - period


def anchors(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """key (of the k-gram), row_key, at (its byte), low and high (its windows start at at - low .. at - high).

    Rows without key are runs: `run` bytes from at on, all of whose windows repeat.
    """

    def find(batches):
        rolling, names = Rolling(), ["key", "row_key", "at", "low", "high", "run"]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lot in parts_of(batch.column(1), SLICE, span - 1):
                sizes = np.array([len(x) for _, _, x in lot], np.int64)
                stops = np.cumsum(sizes)
                begins = stops - sizes
                shift = np.array([at for _, at, _ in lot], np.int64) - begins  # from a place in data to the place in its text
                row = ids[np.array([r for r, _, _ in lot])]
                data = np.frombuffer(b"".join(x for _, _, x in lot), np.uint8)
                grams = rolling(data, gram)
                packed = (grams >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
                least = (sliding_min(packed, span - gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int32)
                owner = np.repeat(np.arange(len(lot), dtype=np.int32), sizes)[: len(least)]
                windows = np.flatnonzero(np.arange(len(least)) + span <= stops[owner])
                if not len(windows):
                    continue
                own = least[windows]
                cut = np.concatenate(([0], np.flatnonzero((np.diff(own) != 0) | (np.diff(windows) != 1)) + 1, [len(own)]))
                low, high, place = windows[cut[:-1]], windows[cut[1:] - 1], own[cut[:-1]].astype(np.int64)
                doc, key = owner[low], grams[place]
                docs_at, places, keys = doc, place, key
                runs: list[tuple[int, int, int]] = []
                near = np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (np.diff(place) > 0) & (np.diff(place) <= PERIOD))
                for d in np.unique(doc[near]):
                    a, b = np.searchsorted(docs_at, [d, d + 1])
                    for start, stop, period in periodic(data, int(begins[d]), int(stops[d]), places[a:b], keys[a:b], span, gram):
                        runs.append((int(d), start, stop - start))
                        # only the windows of the run's first period stay; a row that reaches over both ends becomes two
                        begin, end = start + period, stop - span
                        inside = (doc == d) & (low <= end) & (high >= begin)
                        after = inside & (high > end)
                        more = (np.full(after.sum(), end + 1), high[after], place[after], doc[after], key[after])
                        keep = ~inside | (low < begin)
                        high = np.where(inside, np.minimum(high, begin - 1), high)
                        low, high, place, doc, key = (np.concatenate((x[keep], y)) for x, y in zip((low, high, place, doc, key), more, strict=True))
                    order = np.lexsort((low, doc))
                    low, high, place, doc, key = (x[order] for x in (low, high, place, doc, key))
                columns = [pa.array(key.view(np.int64)), pa.array(row[doc], pa.int64()), pa.array(place + shift[doc], pa.int32()), pa.array(place - low, pa.int16()), pa.array(place - high, pa.int16()), pa.nulls(len(key), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                if runs:
                    d, start, size = np.array(runs, np.int64).T
                    columns = [pa.nulls(len(d), pa.int64()), pa.array(row[d], pa.int64()), pa.array(start + shift[d], pa.int32()), pa.nulls(len(d), pa.int16()), pa.nulls(len(d), pa.int16()), pa.array(size, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("row_key", "text").transform(in_batches(find, ANCHORS))


CONTEXTS = "key long, low short, context binary, at array<struct<row_key:long,start:int>>"
PLACES = pa.list_(pa.struct([("row_key", pa.int64()), ("start", pa.int32())]))


def contexts(docs: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """key, low (of the anchor in the context), context, at (where it starts); equal ones of a batch are one row."""
    lists = found.groupBy("row_key").agg(F.collect_list(F.struct("key", "at", "low", "high")).alias("found"))

    def cut(batches):
        def batch_of(out: dict[tuple, list]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((), (), ())
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int16(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(list(out.values()), PLACES)], names=["key", "low", "context", "at"])

        for batch in batches:
            out: dict[tuple, list] = {}
            held = 0
            flat = batch.column(2).flatten()
            fields = [flat.field(k).to_pylist() for k in range(4)]
            ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(2)), dtype=np.int64)).tolist()
            first = 0
            for row_key, text, end in zip(batch.column(0).to_pylist(), batch.column(1), ends, strict=True):
                data = memoryview(text.as_buffer())
                for key, at, low, high in zip(*(f[first:end] for f in fields), strict=True):
                    row = (key, low, bytes(data[at - low : at - high + span]))
                    places = out.get(row)
                    if places is None:
                        out[row] = places = []
                        held += len(row[-1]) + 200
                    places.append((row_key, at - low))
                    held += 24
                    if held > 8 << 20:
                        yield batch_of(out)
                        out, held = {}, 0
                first = end
            yield batch_of(out)

    return docs.join(lists, "row_key").select("row_key", "text", "found").transform(in_batches(cut, CONTEXTS))


def shared_lengths(group: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """How long a beginning each string shares with another of its group."""
    order = sorted(range(len(strings)), key=lambda i: (group[i], strings[i]))
    out = np.zeros(len(strings), np.int64)
    for at in range(0, len(order) - 1, 4096):
        these = order[at : at + 4097]
        sizes = np.array([len(strings[i]) for i in these])
        width = int(sizes.max()) + 1
        grid = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in these), np.uint8).reshape(len(these), width)
        same = np.minimum((grid[1:] != grid[:-1]).argmax(axis=1) + np.where((grid[1:] == grid[:-1]).all(axis=1), width, 0), np.minimum(sizes[1:], sizes[:-1]))
        same[group[these[1:]] != group[these[:-1]]] = 0
        np.maximum.at(out, these[1:], same)
        np.maximum.at(out, these[:-1], same)
    return out


def repeated_in(distinct: list[bytes], times: np.ndarray, span: int) -> list[np.ndarray]:
    """For each of several distinct contexts, whether the window at each place repeats."""
    starts, text = [], []
    for k, context in enumerate(distinct):
        starts.append(len(text))
        text += [c + len(distinct) for c in context]
        text.append(len(distinct) - 1 - k)  # separators differ, and the last is the smallest
    order = np.array(suffix_array(text))
    whole = np.zeros(len(text), bool)
    for start, context in zip(starts, distinct, strict=True):
        whole[start : start + len(context) - span + 1] = True
    again = np.zeros(len(text), bool)
    order = order[whole[order]]  # between suffixes with equal windows stand only suffixes with that window
    values = np.array(text, np.int32)
    for at in range(0, len(order) - 1, 4096):
        a, b = order[at : at + 4096], order[at + 1 : at + 4097]
        a = a[: len(b)]
        equal = np.ones(len(a), bool)
        for k in range(0, span, 25):
            look = np.flatnonzero(equal)
            steps = np.arange(k, min(k + 25, span))
            equal[look] = (values[a[look, None] + steps] == values[b[look, None] + steps]).all(axis=1)
        again[a[equal]] = again[b[equal]] = True
    return [again[s : s + len(c) - span + 1] | (t > 1) for s, c, t in zip(starts, distinct, times, strict=True)]


def narrowed(context: bytes, at: int, low: int, high: int, span: int) -> tuple[bytes, bytes, int, int] | None:
    """(what all windows with the anchor at offsets low .. high share, those windows' bytes, the anchor in them, their first window).

    context: windows whose anchor lies at `at`; None if none of them is in reach.
    """
    most, least = min(at, high), max(at - len(context) + span, low)
    if most < least:
        return None
    first = at - most
    return context[at - low : at - high + span], context[first : at - least + span], most, first


def halves(low: int, high: int) -> tuple[tuple[int, int], tuple[int, int]]:
    middle = (low + high) // 2
    return (low, middle), (middle + 1, high)


def repeats(distinct: list[bytes], places: np.ndarray, times: np.ndarray, span: int, low: int, high: int) -> list[np.ndarray]:
    """For each of several distinct contexts of one key, whether the window at each place repeats.

    places: the anchor in each; low .. high: its offsets in the key's windows.
    """
    marks = [np.zeros(len(c) - span + 1, bool) for c in distinct]
    work = [(low, high, [(c, int(a), int(t), [(k, 0)]) for k, (c, a, t) in enumerate(zip(distinct, places, times, strict=True))])]
    while work:
        low, high, members = work.pop()
        if len(members) == 1 or sum(len(m[0]) for m in members) <= LARGEST:
            one = [np.full(len(members[0][0]) - span + 1, members[0][2] > 1)]
            found = one if len(members) == 1 else repeated_in([m[0] for m in members], np.array([m[2] for m in members]), span)
            for (context, _, _, owners), mark in zip(members, found, strict=True):
                for k, first in owners:
                    marks[k][first : first + len(context) - span + 1] |= mark
            continue
        for part in halves(low, high):
            groups: dict[bytes, dict[tuple[int, bytes], list]] = {}
            for context, at, n, owners in members:
                if (cut := narrowed(context, at, *part, span)) is not None:
                    core, inner, place, first = cut
                    same = groups.setdefault(core, {}).setdefault((place, inner), [0, []])
                    same[0] += n
                    same[1] += [(k, f + first) for k, f in owners]
            for group in groups.values():
                if len(group) > 1 or next(iter(group.values()))[0] > 1:
                    work.append((*part, [(inner, place, n, owners) for (place, inner), (n, owners) in group.items()]))
    return marks


RUNS = "row_key long, start int, stop int"


def runs_of(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    """Runs with those of a document that touch merged."""
    order = np.lexsort((starts, ids))
    doc, start, stop = ids[order], starts[order], stops[order]
    if len(doc):
        change = np.concatenate(([True], doc[1:] != doc[:-1]))
        shift = np.cumsum(change) * (1 << 32)  # documents apart on one line
        reach = np.maximum.accumulate(stop + shift)
        new = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
        last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(doc) - 1]))
        doc, start, stop = doc[new], start[new], reach[last] - shift[last]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["row_key", "start", "stop"])


def repeated_windows(rows: DataFrame, span: int) -> DataFrame:
    """row_key, start, stop of runs of repeated windows (bytes covered), from the contexts of each key together.

    rows: key, lo and hi (offsets of the key), low, context, times and at (a context that stands for `times` places, of which at still waits for its runs).
    """

    def search(batches):
        for table in groups_of(batches, 1):
            keys, lows, times = (table.column(c).to_numpy() for c in ("key", "low", "times"))
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            data, places = table.column("context").to_pylist(), table.column("at").combine_chunks()
            counts = np.asarray(pc.list_value_length(places), dtype=np.int64)
            flat = places.flatten()
            docs, begins, at_of = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64), np.cumsum(counts) - counts
            group = np.repeat(np.arange(len(at := starts_of([keys])) - 1), np.diff(at))
            right = shared_lengths(group, [c[low:] for c, low in zip(data, lows, strict=True)])
            left = shared_lengths(group, [c[:low][::-1] for c, low in zip(data, lows, strict=True)])
            several = times > 1  # shared with itself, from end to end
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            right, left = np.where(several, sizes - lows, right), np.where(several, lows, left)
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            able = left + right >= span
            for g in np.unique(group[able]):
                trimmed: dict[tuple[int, bytes], list[int]] = {}
                for i in (at[g] + np.flatnonzero(able[at[g] : at[g + 1]])).tolist():
                    begin = int(lows[i] - left[i])
                    trimmed.setdefault((int(left[i]), data[i][begin : lows[i] + right[i]]), []).append(i)
                distinct, copies = [c for _, c in trimmed], [sum(int(times[i]) for i in rows) for rows in trimmed.values()]
                marks = repeats(distinct, np.array([a for a, _ in trimmed]), np.array(copies), span, int(lo[at[g]]), int(hi[at[g]]))
                for rows, mark in zip(trimmed.values(), marks, strict=True):
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], mark, [0])))).reshape(-1, 2)
                    if len(edges):
                        those = spread(at_of[rows], counts[rows])
                        first = begins[those] + np.repeat(lows[rows] - left[rows], counts[rows])
                        for begin, end in edges.tolist():
                            out[0].append(docs[those])
                            out[1].append(first + begin)
                            out[2].append(first + end - 1 + span)
            yield runs_of(*(np.concatenate(x) for x in out))

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return ordered.select("key", "lo", "hi", "low", "context", "times", "at").transform(in_batches(search, RUNS))


LEVEL = "key long, lo short, hi short, low short, context binary, times int, at array<struct<row_key:long,start:int>>, row_key long, start int, stop int"
LEVEL_KINDS = (pa.int64(), pa.int16(), pa.int16(), pa.int16(), pa.binary(), pa.int32(), PLACES)


def collapsed(rows: DataFrame, span: int) -> DataFrame:
    """Equal contexts of a key as one row, in LEVEL; rows without context are runs, of places that are done.

    A context that occurs twice is repeated as a whole: its places get their run as they come, and the row that is left
    has none. So a task holds one row at a time, however many are equal.
    """

    def run(batches):
        held: list | None = None
        for batch in batches:
            kept: list[list] = []
            done: list[tuple[int, int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, _, _, low, context, times, at = row
                if held is not None and (held[0], held[3], held[4]) == (key, low, context):
                    done += [(p["row_key"], p["start"], p["start"] + len(context)) for p in (*held[6], *at)]
                    held[5], held[6] = 2, []
                    continue
                if held is not None:
                    kept.append(held)
                held = [*row[:6], at]
                if times > 1:
                    done += [(p["row_key"], p["start"], p["start"] + len(context)) for p in at]
                    held[6] = []
            yield level_batch(kept, done)
        if held is not None:
            yield level_batch([held], [])

    columns = ["key", "lo", "hi", "low", "context", "times", "at"]
    ordered = rows.repartition("key", "low", "context").sortWithinPartitions("key", "low", "context")
    return ordered.select(*columns).transform(in_batches(run, LEVEL))


def level_batch(kept: list[list], done: list[tuple[int, int, int]]) -> pa.RecordBatch:
    n, m = len(kept), len(done)
    columns = [pa.array([r[k] for r in kept] + [None] * m, kind) for k, kind in enumerate(LEVEL_KINDS)]
    columns += [pa.array([None] * n + [d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in LEVEL.split(", ")])


def refined(rows: DataFrame, span: int) -> DataFrame:
    """The contexts of each row's two halves of offsets, under keys that are hashes of what those windows share."""
    import xxhash

    names = ["key", "lo", "hi", "low", "context", "times", "at"]

    def cut(batches):
        for batch in batches:
            out: list[list] = []
            for _, lo, hi, low, context, times, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in halves(lo, hi) if lo < hi else ():
                    if (found := narrowed(context, low, *part, span)) is not None:
                        core, inner, place, first = found
                        key = xxhash.xxh3_64_intdigest(core, seed=part[0] << 8 | part[1])
                        out.append([key - (key >> 63 << 64), *part, place, inner, times, [(p["row_key"], p["start"] + first) for p in at]])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(LEVEL_KINDS)], names=names)

    return rows.select(*names).transform(in_batches(cut, LEVEL.split(", row_key long")[0]))


def crowded_windows(rows: DataFrame, span: int, many: int) -> DataFrame:
    """What repeated_windows gives, for keys with more than `many` contexts: their offsets are halved until no key has."""
    found = None
    while True:
        level = written(collapsed(rows, span), "level")
        own = level.filter("context is null").select("row_key", "start", "stop")
        rows = written(refined(level.filter("context is not null"), span), "refined")
        counts = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
        few = rows.join(counts.filter(F.col("n") <= many).select("key"), "key", "left_semi")
        own = own.union(repeated_windows(few, span))
        found = own if found is None else found.union(own)
        crowded = counts.filter(F.col("n") > many).select("key")
        if not crowded.limit(1).count():
            return found
        rows = rows.join(crowded, "key", "left_semi")


def repeated_spans(docs: DataFrame, span: int = 200, gram: int = 32, many: int = MANY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns in keep, spans: array<struct<start, stop>> of bytes to remove, in any order, touching or overlapping."""
    docs, _ = keyed(docs.select("doc_id", text_of().alias("text"), *keep))
    others = docs.select("row_key", "doc_id", *keep)
    docs = docs.select("row_key", "text").filter("row_key is not null")  # none is; with equal columns and filters both joins of the texts use one shuffle
    each = written(anchors(docs, span, gram), "anchors")
    runs = each.filter("key is null").select("row_key", F.col("at").alias("start"), (F.col("at") + F.col("run")).alias("stop"))
    each = each.filter("key is not null").drop("run")
    keys = written(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    crowded = keys.filter(F.col("n") > many).select("key")
    several = lambda keys: contexts(docs, each.join(keys, "key", "left_semi"), span).selectExpr("key", "0S as lo", f"{span - gram}S as hi", "low", "context", "size(at) as times", "at")
    # a join, not a window: a hot key's rows can be split
    runs = runs.union(repeated_windows(several(keys.filter(F.col("n") <= many).select("key")), span))
    if crowded.limit(1).count():
        runs = runs.union(crowded_windows(several(crowded), span, many))
    lists = runs.groupBy("row_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(lists, "row_key", "left").join(others, "row_key").select("doc_id", "text", *keep, "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, stop in spans:
        out.append(data[at:start])
        at = stop
    return b"".join([*out, data[at:]])


def dedup_digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def digest(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data, cut = bytes(text.as_buffer()), merged(found.as_py())
                out.append((len(data), sum(b - a for a, b in cut), len(cut), hashlib.sha256(without(data, cut)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=names)

    return spans.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").transform(in_batches(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def kept_texts(spans: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the text that is left, and the columns in keep; a character that loses a byte goes whole."""

    def left_of(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1), 4 * SLICE):
                left = [without(bytes(t.as_buffer()), merged(s.as_py())).decode(errors="ignore") for t, s in zip(texts, batch.column(2).slice(first, len(texts)), strict=True)]
                others = [batch.column(3 + k).slice(first, len(texts)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(left, pa.string()), *others], names=["doc_id", "text", *keep])

    kinds = [f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in ("doc_id", "text", *keep)]
    return spans.select("doc_id", "text", "spans", *keep).transform(in_batches(left_of, ", ".join(kinds)))
