"""Operator 11, LM scoring: n-gram counts in a log-frequency Bloom filter, from which texts get smoothed log-probabilities.

Counting: every n-gram of every learning text is counted by a 60-bit hash. Tasks pre-aggregate and send sorted
hashes and counts to slots (the hash's upper bits); a slot adds them up, quantises a count c to q = bit length of c
(1, 2-3, 4-7, ...) and puts the pairs (n-gram, 1) ... (n-gram, q) into a bit array sized by their number. All
slots together are the filter. Since a slot's size follows its content, the share of false positives is the same
at every size of the corpus.

Asking: an n-gram is probed at 1, 2, ... until a probe fails; the last success gives q, and q stands for the mean
count of its range. A count of a longer n-gram is at most those of its parts, which also catches false positives.
p(w) = (c(w) + 1) / (N + V + 1), and for longer contexts p(w | h) = (c(hw) + weight p(w | shorter h)) / (c(h) + weight).

The filter is broadcast in slabs of whole slots, each of at most `slab_bytes` (or one slot). One slab is the usual
case; a corpus with more n-grams takes a pass over the texts for each slab, and each pass adds what its slab knows.

The plain unigram score needs exact counts. Tokens common enough to number at most `common` are broadcast (short
ones, so at most common * (max_token + 8) bytes); those of each text that aren't among them meet the counts in a
join of their own, one row for each text and token.

Defined cases: a null text is empty and has its end as only token; a null doc_id counts as '' in the hash, so the
row teaches; repeated rows are scored each and teach each; ties don't arise; a very long text is held alone; without
learning texts N and V are 0 and every token has probability 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import give_back, in_batches, mix64, slices, spread, words_of
from tabulon.sources.shared import new_folder, removed, spread_out, stored, written

ODD = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0x5851F42D4C957F2D)
LOW = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class CountModel:
    """filter: slot, n_bits, bits in a table; slot s has bits starts[s] ... starts[s + 1] of the whole, which is cut at the slots in slabs."""

    order: int
    tokens: int
    kinds: int
    texts: int
    probes: int
    filter: DataFrame
    starts: np.ndarray
    slabs: tuple[tuple[int, int], ...]
    counts: DataFrame
    common: pa.Table


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As words_of, in lower case, with the end of each text as its last token: '', the last of the distinct ones."""
    offsets, numbers, distinct = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    n = len(texts)
    out = np.full(len(numbers) + n, len(distinct), np.int64)
    out[np.arange(len(numbers)) + np.repeat(np.arange(n), np.diff(offsets))] = numbers
    return offsets + np.arange(n + 1), out, pa.concat_arrays([distinct.cast(pa.string()), pa.array([""])])


def hashes_of(offsets: np.ndarray, numbers: np.ndarray, distinct: pa.Array, order: int) -> list[np.ndarray]:
    """The 60-bit hashes of the n-grams of 1 ... order tokens that end at each token, with starts before the first."""
    own = np.array(list(map(xxhash.xxh3_64_intdigest, distinct.to_pylist())), np.uint64)
    token = own[numbers]
    out, longer = [mix64(token) >> np.uint64(4)], token
    for _ in range(1, order):  # the hash of a longer n-gram is made of that of its beginning, which ends one token earlier
        before = np.empty_like(longer)
        before[1:] = longer[:-1]
        before[offsets[:-1]] = START
        longer = mix64(before * ODD + token)
        out.append(longer >> np.uint64(4))
    return out


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def packed(keys: np.ndarray, counts: np.ndarray, slot_bits: int) -> pa.RecordBatch:
    """Rows (slot, grams, counts) of sorted keys; the slot is the upper bits of a key, 6 bytes of the rest are kept."""
    slots = (keys >> np.uint64(60 - slot_bits)).astype(np.int32)
    starts = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
    ends = np.append(starts, len(keys))
    six = np.ascontiguousarray((keys & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])

    def blobs(data: np.ndarray, width: int) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(data.tobytes())])

    return pa.RecordBatch.from_arrays([pa.array(slots[starts]), blobs(six, 6), blobs(counts.astype("<u4"), 4)], names=["slot", "grams", "counts"])


def gram_counter(order: int, slot_bits: int, slice_bytes: int, hold: int):
    """Counts n-grams of column 0, adding up in the task until `hold` distinct ones are at hand."""

    def count(batches):
        keys, counts, size = [], [], 0

        def merged():
            return added_up(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 1 else (keys[0], counts[0])

        for batch in batches:
            for _, texts in slices(batch.column(0), slice_bytes):
                k, c = counted(np.concatenate(hashes_of(*tokens_of(texts), order)))
                keys, counts, size = [*keys, k], [*counts, c], size + len(k)
                if size > hold:
                    k, c = merged()
                    if len(k) > hold // 2:
                        yield packed(k, c, slot_bits)
                        keys, counts, size = [], [], 0
                    else:
                        keys, counts, size = [k], [c], len(k)
        if keys:
            yield packed(*merged(), slot_bits)

    return count


def spots(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit numbers of the pair (n-gram, level), from which all its bits follow."""
    x = mix64((keys & LOW) + np.uint64(level * int(ODD) % (1 << 64)))
    return x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)


def position(spot: tuple[np.ndarray, np.ndarray], probe: int, n_bits: np.ndarray | int) -> np.ndarray:
    """Where bit number `probe` lies among n_bits bits, fewer than 2 ** 32."""
    x = (spot[0] + np.uint64(probe) * spot[1]) & np.uint64(0xFFFFFFFF)
    return (x * np.asarray(n_bits, dtype=np.uint64) >> np.uint64(32)).astype(np.int64)


def slot_builder(bits_each: int, probes: int, hold: int = 1 << 22):
    """The bit array of each slot, from rows (slot, grams, counts) sorted by slot; a slot's counts are added up as they come."""

    def build(batches):
        def rows() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                for slot, grams, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
                    six = np.frombuffer(grams.as_buffer(), np.uint8).reshape(-1, 6)
                    keys = np.zeros((len(six), 8), np.uint8)
                    keys[:, :6] = six
                    yield slot.as_py(), keys.view("<u8")[:, 0], np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)

        def bits(slot: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            q = np.frexp(counts.astype(np.float64))[1]
            n_bits = min(-(-int(q.sum()) * bits_each // 64) * 64, (1 << 32) - 64)
            marked = np.zeros(n_bits, bool)
            for level in range(1, int(q.max()) + 1):
                spot = spots(keys[q >= level], level)
                for probe in range(probes):
                    marked[position(spot, probe, n_bits)] = True
            names = ["slot", "n_bits", "bits"]
            return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([n_bits]), pa.array([np.packbits(marked, bitorder="little").tobytes()])], names=names)

        at, keys, counts, size = None, [], [], 0
        for slot, k, c in rows():
            if at is not None and (slot != at or size > hold):
                all_keys, all_counts = added_up(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [all_keys], [all_counts], 0
                if slot != at:
                    yield bits(at, all_keys, all_counts)
                    keys, counts = [], []
                    give_back()
            at, keys, counts, size = slot, [*keys, k], [*counts, c], size + len(k)
        if keys:
            yield bits(at, *added_up(np.concatenate(keys), np.concatenate(counts)))

    return build


def token_counter(slice_bytes: int, hold: int = 1 << 19):
    """Rows (token, n) of column 0, added up in the task until `hold` are at hand."""

    def count(batches):
        parts, size = [], 0
        for batch in batches:
            for _, texts in slices(batch.column(0), slice_bytes):
                _, numbers, distinct = tokens_of(texts)
                parts.append(pa.table({"token": distinct, "n": np.bincount(numbers, minlength=len(distinct))}))
                size += len(distinct)
                if size > hold:
                    parts = [summed(parts)]
                    size = len(parts[0])
                    if size > hold // 2:
                        yield from parts[0].to_batches(1 << 16)
                        parts, size = [], 0
        if parts:
            yield from summed(parts).to_batches(1 << 16)

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])

    return count


def learn(texts: DataFrame, order: int = 2, bits_each: int = 8, probes: int = 4, slots: int = 4096, slab_bytes: int = 64 << 20, common: int = 1 << 18, max_token: int = 64, slice_bytes: int = 1 << 20, hold: int = 1 << 21) -> CountModel:
    """From the column text of all rows. slots: a power of two up to 65,536; a task has a slot's share of the distinct n-grams at hand."""
    slot_bits = slots.bit_length() - 1
    if 1 << slot_bits != slots or slot_bits > 16:
        raise ValueError("slots is a power of two up to 65,536")
    texts = texts.select("text")
    counts = written(texts.transform(in_batches(token_counter(slice_bytes), "token string, n long")).groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ended = counts.filter("token = ''").first()

    short, rank = F.octet_length("token") <= max_token, F.floor(F.log2("n") * 8)
    ranks, least, room = counts.filter(short).groupBy(rank.alias("rank")).count().orderBy(F.desc("rank")).collect(), None, common  # a few hundred
    for r in ranks:
        room -= r["count"]
        if room < 0:
            break
        least = r["rank"]
    known = counts.filter(short & (rank >= least) if least is not None else F.lit(False)).toArrow().combine_chunks()

    grams = texts.transform(in_batches(gram_counter(order, slot_bits, slice_bytes, hold), "slot int, grams binary, counts binary"))
    grams = grams.repartition("slot").sortWithinPartitions("slot")
    made = written(grams.transform(in_batches(slot_builder(bits_each, probes), "slot int, n_bits long, bits binary")), "filter")
    sizes = np.zeros(slots, np.int64)
    for slot, n_bits in made.select("slot", "n_bits").collect():  # one row a slot
        sizes[slot] = n_bits
    starts = np.concatenate(([0], np.cumsum(sizes)))
    slabs, low = [], 0
    while low < slots:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + slab_bytes * 8, side="right")) - 1)
        slabs.append((low, high))
        low = high
    return CountModel(order, tokens, kinds, ended["n"] if ended else 0, probes, made, starts, tuple(slabs), counts, known)


def quantised(keys: np.ndarray, bits: np.ndarray, starts: np.ndarray, slab: tuple[int, int], slot_bits: int, probes: int) -> np.ndarray:
    """q of each n-gram as the slab has it; 0 where it has none or the slot is another slab's. Each different one is asked for once, in the order of slots."""
    keys, back = np.unique(keys, return_inverse=True)
    q = np.zeros(len(keys), np.uint8)
    slot = (keys >> np.uint64(60 - slot_bits)).astype(np.int64)
    n_bits = starts[slot + 1] - starts[slot]
    alive = np.flatnonzero((slot >= slab[0]) & (slot < slab[1]) & (n_bits > 0))
    keys, base, n_bits = keys[alive], (starts[slot] - starts[slab[0]])[alive], n_bits[alive].astype(np.uint64)
    level = 0
    while len(alive):
        level += 1
        spot, left = spots(keys, level), np.arange(len(alive))
        for probe in range(probes):
            at = position((spot[0][left], spot[1][left]), probe, n_bits[left]) + base[left]
            left = left[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        alive, keys, base, n_bits = alive[left], keys[left], base[left], n_bits[left]
        q[alive] = level
    return q[back]


def typical(q: np.ndarray) -> np.ndarray:
    """The mean of the counts that q stands for: 0, 1, 2.5, 5.5, 11.5, ..."""
    return np.where(q > 0, 0.75 * np.exp2(q.astype(np.float64)) - 0.5, 0.0)


def log_probabilities(codes: list[np.ndarray], offsets: np.ndarray, tokens: int, kinds: int, texts: int, weight: float) -> np.ndarray:
    """log10 p of each token. codes: q of the n-grams of 1, 2, ... tokens that end there."""
    p = (typical(codes[0]) + 1) / (tokens + kinds + 1)
    for k in range(1, len(codes)):
        context = np.empty_like(codes[k - 1])
        context[1:] = codes[k - 1][:-1]
        context[offsets[:-1]] = texts.bit_length()  # what begins a text has been seen once a text
        both = np.minimum(codes[k], np.minimum(context, codes[k - 1]))
        p = (typical(both) + weight * p) / (typical(context) + weight)
    return np.log10(p)


def scored(docs: DataFrame, model: CountModel, keep: tuple[str, ...] = ("doc_id",), weight: float = 32.0, slice_bytes: int = 2 << 20) -> DataFrame:
    """keep, n_tokens, n_known, base_score and score of each row's column text."""
    spark = docs.sparkSession
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    order, tokens, kinds, texts, starts, slabs, probes = model.order, model.tokens, model.kinds, model.texts, model.starts, model.slabs, model.probes
    slot_bits = (len(starts) - 1).bit_length() - 1
    common = spark.sparkContext.broadcast((pc.cast(model.common["token"].combine_chunks(), pa.string()), model.common["n"].to_numpy()))

    def loaded(slab: tuple[int, int]):
        """The slab's bits as a broadcast; each slot lies at its place in the whole, less the slab's first."""
        bits = np.zeros(int(starts[slab[1]] - starts[slab[0]]) // 8, np.uint8)
        for slot, part in model.filter.filter((F.col("slot") >= slab[0]) & (F.col("slot") < slab[1])).select("slot", "bits").toLocalIterator():
            at = int(starts[slot] - starts[slab[0]]) // 8
            bits[at : at + len(part)] = np.frombuffer(part, np.uint8)
        return spark.sparkContext.broadcast(bits)

    def coded(slab: tuple[int, int], bits, told: bool) -> Callable:
        """(offsets, numbers, distinct, codes of each order) of a slice, with what the slab knows added to the codes so far."""

        def of(texts: pa.Array, before: pa.Array | None):
            offsets, numbers, distinct = tokens_of(texts)
            codes = [quantised(h, bits.value, starts, slab, slot_bits, probes) for h in hashes_of(offsets, numbers, distinct, order)]
            if told:
                sizes = np.diff(offsets)
                flat = np.frombuffer(b"".join(before.to_pylist()), np.uint8)
                codes = [np.maximum(c, flat[spread(offsets[:-1] * order + k * sizes, sizes)]) for k, c in enumerate(codes)]
            return offsets, numbers, distinct, codes

        return of

    def carry(of: Callable, told: bool) -> Callable:
        def run(batches):
            for batch in batches:
                for first, part in slices(batch.column(0), slice_bytes):
                    offsets, _, _, codes = of(part, batch.column(1).slice(first, len(part)) if told else None)
                    joined = [b"".join(c[a:b].tobytes() for c in codes) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    rest = [c.slice(first, len(part)) for c in batch.columns[1 + told :]]
                    yield pa.RecordBatch.from_arrays([part, pa.array(joined, pa.binary()), *rest], names=["text", "codes", *keep])

        return run

    def finish(of: Callable, told: bool) -> Callable:
        def run(batches):
            for batch in batches:
                for first, part in slices(batch.column(0), slice_bytes):
                    offsets, numbers, distinct, codes = of(part, batch.column(1).slice(first, len(part)) if told else None)
                    sizes, n = np.diff(offsets), len(part)
                    owner = np.repeat(np.arange(n), sizes)
                    score = np.bincount(owner, log_probabilities(codes, offsets, tokens, kinds, texts, weight), n)
                    found = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=common.value[0]), -1), dtype=np.int64)
                    c = np.append(common.value[1], 0)[found]
                    known = (found >= 0)[numbers]
                    base = np.bincount(owner, np.where(known, np.log10((c[numbers] + 1) / (tokens + kinds + 1)), 0.0), n)
                    rare = np.flatnonzero(~known)
                    pairs, times = np.unique(owner[rare] * len(distinct) + numbers[rare], return_counts=True)
                    ends = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(distinct)), pa.int32())
                    structs = pa.StructArray.from_arrays([distinct.take(pa.array(pairs % len(distinct))), pa.array(times)], names=["token", "times"])
                    rest = [x.slice(first, n) for x in batch.columns[1 + told :]]
                    columns = [*rest, pa.array(sizes, pa.int64()), pa.array(np.bincount(owner, known, n).astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(ends, structs)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "n_known", "base_score", "score", "rare"])

        return run

    docs, path, last = spread_out(docs.select("text", *keep)), None, slabs[-1]
    for slab in slabs[:-1]:
        bits, to = loaded(slab), new_folder(spark, "codes")
        docs = stored(docs.transform(in_batches(carry(coded(slab, bits, path is not None), path is not None), ", ".join(["text string", "codes binary", *fields]))), to)
        bits.destroy()
        if path:
            removed(spark, path)
        path = to
    schema = ", ".join([*fields, "n_tokens long, n_known long, base_score double, score double, rare array<struct<token: string, times: bigint>>"])
    bits = loaded(last)
    done = docs.transform(in_batches(finish(coded(last, bits, path is not None), path is not None), schema))
    done = written(done.withColumn("row", F.monotonically_increasing_id()), "scores")
    for sent in (bits, common):  # workers would keep them
        sent.destroy()
    if path:
        removed(spark, path)
    if not model.kinds:
        return done.drop("rare", "row")
    pairs = done.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times").join(model.counts, "token", "left")
    worth = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(tokens + kinds + 1)))
    rare = pairs.groupBy("row").agg(F.sum(worth).alias("rare_score"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"))
    both = done.drop("rare").join(rare, "row", "left")
    whole = {"n_known": F.col("n_known") + F.coalesce("rare_known", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("rare_score", F.lit(0.0))}
    return both.withColumns(whole).drop("row", "rare_score", "rare_known")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores all documents by what those that are not held out teach."""
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = learn(docs.filter(~F.col("held_out")))
    return scored(docs, model, ("doc_id", "held_out")).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
