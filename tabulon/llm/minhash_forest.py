"""Operator 2, n-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Each text becomes its set of word shingles. Texts with equal sets form a class; only classes go on, and only sets
   that are large enough to have a different set as near as the threshold.
2. Forest. A class has one label for each of `trees` tries: the values of `depth` MinHash functions. Two classes that
   share a prefix of a label lie below one node of that trie. `floor_depth` is the shortest prefix that the target
   recall can ask for, at the threshold; the nodes of that depth are dealt out as tasks.
3. Below a node, labels are sorted, and each class walks up from its whole label to shorter prefixes (`walk`). At
   each step it compares whole signatures with the classes that share the prefix, which is a range of the sorted labels. The similarities of those it has
   met so far, each weighted by the chance of meeting it, estimate the recall that all tries together reach with
   this prefix; one more pair at the threshold is assumed unseen. The class stops as soon as the estimate reaches the
   target: among many close copies at long prefixes, without any only at the floor.
   Below a crowded node (`PACKET`) classes are first linked to their neighbours in sorted order (`neighbours`); what all
   trees have linked so is one set, and only classes of different sets are compared (`across`). So work among many close
   copies grows with their number, not with its square.
4. A spanning forest of the likely pairs links classes into candidate groups. No row exists for a pair.
5. Pairs of a candidate group are verified exactly on their shingle sets, in blocks of at most `BLOCK` classes and
   about `BLOCK_BYTES` bytes against each other. Classes lie in bands of size, and only sets of one or of adjacent bands can be
   as near as the threshold, so blocks further apart never meet. Each block pair gives the number of links of
   each class and a spanning forest of the links.

Words are split at white space and lower-cased. A text of fewer words than a shingle is one shingle.

Defined cases: a null text is empty; a text without words is a class of its own without links; each row is a document of
its own, also where doc_ids repeat or are null (rows without one come last); very long texts are held one at a time; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import groups_of, in_batches, keyed, mix64, slices, starts_of, text_of, words_of
from tabulon.llm.graph import components
from tabulon.sources.shared import written

BLOCK = 256
BLOCK_BYTES = 4 << 20
PACKET = 512
SLICE = 1 << 20


def met(similarity: float | np.ndarray, trees: int, prefix: int) -> float | np.ndarray:
    """How likely a pair shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def floor_depth(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix at which a pair as similar as threshold meets with probability target; at least 1."""
    while depth > 1 and met(threshold, trees, depth) < target:
        depth -= 1
    return depth


def hashed_words(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in pc.utf8_lower(distinct).to_pylist()), np.uint64, len(distinct))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the shingles of each text in order; repeats stay."""
    offsets, numbers, distinct = words_of(texts)
    words = hashed_words(distinct)[numbers] if len(distinct) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    counts = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    out = np.concatenate(([0], np.cumsum(counts)))
    total = int(out[-1])
    at = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(total)
    stop = np.repeat(offsets[1:], counts)
    value = np.zeros(total, np.uint64)
    for k in range(size):
        inside = at + k < stop
        step = words[np.minimum(at + k, max(len(words) - 1, 0))] if total else value
        value = np.where(inside, (value ^ step) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1), value)
    return mix64(value), out


def unique_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) with each text's hashes sorted and without repeats."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(offsets) - 1))))


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set of hashes, which needs no order but takes each hash once, and its size."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    short = (owner << np.uint64(44)) | (hashes >> np.uint64(20))
    short = np.sort(short)
    keep = np.ones(len(short), bool)
    keep[1:] = short[1:] != short[:-1]
    short = short[keep]
    sizes = np.bincount((short >> np.uint64(44)).astype(np.int64), minlength=len(offsets) - 1)
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    value = short & np.uint64((1 << 44) - 1)
    full = sizes > 0
    out = []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        key = np.zeros(len(sizes), np.uint64)
        if full.any():
            key[full] = np.add.reduceat(mix64(value ^ np.uint64(seed)), at[full])
        out.append(key.view(np.int64))
    return out[0], out[1], sizes


def minima(hashes: np.ndarray, offsets: np.ndarray, functions: int, seed: int = 1) -> np.ndarray:
    """MinHash values (uint16) of each non-empty set: texts x functions."""
    draw = np.random.default_rng(seed)
    factor = draw.integers(0, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 1 << 63, functions, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, functions), np.uint16)
    if len(full):
        starts = offsets[full]
        for k in range(functions):
            value = ((hashes * factor[k] + shift[k]) >> np.uint64(32)).astype(np.uint32)
            # of the smallest value any 16 bits would do; mixed, they don't share its leading zeros
            out[full, k] = ((np.minimum.reduceat(value, starts).astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(12)).astype(np.uint16)
    return out


SIGNED = "row_key long, key_a long, key_b long, n int, signature binary"


def signed(docs: DataFrame, size: int, functions: int) -> DataFrame:
    """row_key, the keys and the size of its shingle set, and its MinHash signature (null without words)."""

    def sign(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE):
                hashes, offsets = shingles(texts, size)
                a, b, n = set_keys(hashes, offsets)
                values = minima(hashes, offsets, functions)
                signature = [values[i].tobytes() if offsets[i + 1] > offsets[i] else None for i in range(len(texts))]
                columns = [batch.column(0).slice(first, len(texts)), pa.array(a), pa.array(b), pa.array(n, pa.int32()), pa.array(signature, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row_key", "key_a", "key_b", "n", "signature"])

    return docs.select("row_key", "text").transform(in_batches(sign, SIGNED))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place connected with each of n places by the edges a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def equal_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places each signature of a agrees with each of b."""
    if len(a) * len(b) <= 4096:
        return (a[:, None] == b[None]).sum(axis=2, dtype=np.uint8)
    out = np.zeros((len(a), len(b)), np.uint8)
    for f in range(a.shape[1]):
        out += a[:, f][:, None] == b[:, f][None]
    return out


def walk(values: np.ndarray, below: np.ndarray, left: np.ndarray, right: np.ndarray, trees: int, floor: int, threshold: float, target: float, least_equal: int) -> tuple[np.ndarray, np.ndarray]:
    """Likely pairs (places) that left meets in right, from whole labels up to prefixes of `floor` values.

    below: what follows the floor in the labels, 16 bits for each value, the first uppermost.
    """
    out_a, out_b = [], []
    deepest = floor + 4
    left, right = left[np.argsort(below[left], kind="stable")], right[np.argsort(below[right], kind="stable")]
    labels = below[right]
    for p in range(0, len(left), 64):
        part = left[p : p + 64]
        own = below[part]
        likeness = np.zeros((len(part), len(right)), np.float32)
        active, waiting = np.ones(len(part), bool), part[:, None] != right[None]
        for depth in range(deepest, floor - 1, -1):
            # those that share a prefix lie side by side: its range in the sorted labels
            bits = np.uint64(16 * (deepest - depth))
            rest = (np.uint64(1) << bits) - np.uint64(1) if depth > floor else np.uint64((1 << 64) - 1)
            low, high = np.searchsorted(labels, own & ~rest, "left"), np.searchsorted(labels, own | rest, "right")
            first, last = int(low[active].min()), int(high[active].max())
            places = np.arange(first, last)
            reached = waiting[:, first:last] & active[:, None] & (places >= low[:, None]) & (places < high[:, None])
            rows, columns = np.flatnonzero(reached.any(axis=1)), np.flatnonzero(reached.any(axis=0))
            if len(rows):
                equal = equal_values(values[part[rows]], values[right[first + columns]])
                good = reached[np.ix_(rows, columns)] & (equal >= least_equal)
                u, v = np.nonzero(good)
                out_a.append(part[rows[u]])
                out_b.append(right[first + columns[v]])
                likeness[rows[u], first + columns[v]] = equal[u, v] / values.shape[1]
                waiting[:, first:last] &= ~reached
            if depth == floor:
                break
            u, v = np.nonzero(likeness)
            similar = likeness[u, v].astype(np.float64)
            weight = similar**-depth  # one over the chance of meeting it in this tree
            total = np.bincount(u, weight, len(part)) + 1
            caught = np.bincount(u, weight * met(similar, trees, depth), len(part)) + met(threshold, trees, depth)
            active &= caught < target * total
            if not active.any():
                break
    return np.concatenate([*out_a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*out_b, np.zeros(0, np.int64)]).astype(np.int64)


NEIGHBOURS = 4


def neighbours(members: DataFrame, depth: int, least_equal: int) -> DataFrame:
    """Spanning edges (a, b) of classes that lie next to each other, up to NEIGHBOURS apart, in the sorted labels below a node, and whose signatures agree.

    members: tree, node, class_id, signature. The sort is one over all nodes, cut anywhere, so no node is one task's; a
    row is looked at with a few others, however many its node has.
    """

    def compare(batches):
        held, kept = [], np.zeros((0, 0), np.uint16)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = [batch.column(k).to_numpy() for k in range(3)]
            if len(kept):
                values, keys = np.concatenate((kept, values)), [np.concatenate(x) for x in zip(held, keys, strict=True)]
            out_a, out_b, old = [], [], len(kept)
            for step in range(1, min(NEIGHBOURS, len(values) - 1) + 1):
                late = np.arange(max(step, old), len(values))
                late = late[(keys[0][late] == keys[0][late - step]) & (keys[1][late] == keys[1][late - step])]
                alike = late[(values[late] == values[late - step]).sum(axis=1) >= least_equal]
                out_a.append(alike)
                out_b.append(alike - step)
            none = np.zeros(0, np.int64)
            root = roots(len(values), np.concatenate([*out_a, none]), np.concatenate([*out_b, none]))  # an edge for each row at most
            far = np.flatnonzero(root != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[2][far]), pa.array(keys[2][root[far]])], names=["a", "b"])
            held, kept = [k[-NEIGHBOURS:] for k in keys], values[-NEIGHBOURS:]

    order = ["tree", "node", "label", "class_id"]
    rows = members.withColumn("label", F.expr(f"substring(signature, {2 * depth} * tree + 1, {2 * depth})"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("tree", "node", "class_id", "signature").transform(in_batches(compare, "a long, b long"))


def across(rows: DataFrame, size: int) -> DataFrame:
    """rows (tree, node, class_id, root) of crowded nodes, dealt so that all pairs meet but those within the node's largest set of one root.

    Sets are linked already. The rows outside the largest one are dealt into blocks of about `size`, as are those in it;
    a block of the former meets all blocks. So in a node of close copies the few that are left over meet all others, and
    a node with nothing left over is done. Adds i, j, left and right (whether the row is in block i, in block j), i <= j.
    """
    key = ["tree", "node"]
    sets = rows.groupBy(*key, "root").agg(F.count("*").alias("n"))
    facts = sets.groupBy(*key).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("n")).filter("n > in_main")
    blocks = lambda c: F.ceil(c / size).cast("int")
    facts = facts.select(*key, "main", blocks(F.col("n") - F.col("in_main")).alias("others"), blocks(F.col("in_main")).alias("mains"))
    rows = rows.join(facts, key).withColumn("inside", F.col("root") == F.col("main"))
    at = F.xxhash64("class_id")
    side = F.when(F.col("inside"), F.col("others") + F.pmod(at, F.col("mains"))).otherwise(F.pmod(at, F.col("others"))).cast("int")
    last = F.when(F.col("inside"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    rows = rows.withColumn("side", side).select("*", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    rows = rows.select("class_id", *key, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    return rows.select("class_id", *key, "i", "j", (F.col("side") == F.col("i")).alias("left"), (F.col("side") == F.col("j")).alias("right"))


def candidate_groups(able: DataFrame, trees: int, depth: int, floor: int, threshold: float, target: float, least_equal: int, packet: int) -> DataFrame:
    """node, root: classes (class_id, signature) that likely pairs connect, but the roots themselves.

    Below a node of up to `packet` classes they are compared by `walk`. Below a crowded one, neighbours in sorted order are
    linked first, which all trees together make few sets of many close copies; then only classes of different sets meet.
    """
    signature = able.select("class_id", "signature")
    placed = written(nodes(able, trees, depth, floor), "nodes")
    counts = written(placed.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    few = placed.join(counts.filter(F.col("n") <= packet).select("tree", "node"), ["tree", "node"])
    few = few.select("class_id", "tree", "node", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    compared = lambda rows: likely(rows.join(signature, "class_id"), trees, depth, floor, threshold, target, least_equal)
    crowded = counts.filter(F.col("n") > packet).select("tree", "node")
    if not crowded.limit(1).count():
        return components(compared(few))
    rows = placed.join(crowded, ["tree", "node"])
    sets = components(compared(few).union(neighbours(rows.join(signature, "class_id"), depth, least_equal)))
    named = sets.select(F.col("node").alias("class_id"), "root")
    rest = written(across(rows.join(named, "class_id", "left").withColumn("root", F.coalesce("root", "class_id")), packet), "across")
    if not rest.limit(1).count():
        return sets
    more = compared(rest)
    of = lambda c: named.select(F.col("class_id").alias(c), F.col("root").alias(f"root_{c}"))
    more = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    over = components(more)  # of sets
    later = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = sets.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(over.join(sets.select("node"), "node", "left_anti"))


def likely(members: DataFrame, trees: int, depth: int, floor: int, threshold: float, target: float, least_equal: int) -> DataFrame:
    """Spanning edges (a, b) of the classes that meet below the nodes and whose signatures agree in at least least_equal places."""

    def compare(batches):
        for table in groups_of(batches, 4):
            cols = [table.column(k).to_numpy() for k in range(4)]
            ids, lefts, rights = (table.column(c).to_numpy() for c in ("class_id", "left", "right"))
            values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(ids), -1)
            own = values.reshape(len(ids), trees, depth)[np.arange(len(ids)), cols[0]]
            below = np.zeros(len(ids), np.uint64)
            for k in range(4):
                below = below << np.uint64(16) | (own[:, floor + k].astype(np.uint64) if floor + k < depth else np.uint64(0))
            at = starts_of(cols)
            two = np.flatnonzero(np.diff(at) == 2)
            x, y = at[two], at[two] + 1  # they meet at the floor at the latest
            same = (values[x] == values[y]).sum(axis=1) >= least_equal
            out_a, out_b = [ids[x[same]]], [ids[y[same]]]
            for g in np.flatnonzero(np.diff(at) > 2):
                start, end = at[g], at[g + 1]
                a, b = walk(values, below, start + np.flatnonzero(lefts[start:end]), start + np.flatnonzero(rights[start:end]), trees, floor, threshold, target, least_equal)
                order = np.argsort(ids[start:end], kind="stable")  # places by id, so that roots are smallest ids
                place = np.empty(end - start, np.int64)
                place[order] = np.arange(end - start)
                here = ids[start:end][order]
                root = roots(end - start, place[a - start], place[b - start])
                far = root != np.arange(end - start)
                out_a.append(here[far])
                out_b.append(here[root[far]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    ordered = members.repartition("tree", "node", "i", "j").sortWithinPartitions("tree", "node", "i", "j")
    return ordered.select("tree", "node", "i", "j", "class_id", "left", "right", "signature").transform(in_batches(compare, "a long, b long"))


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets with all others (None: with themselves)."""
    both = sets if others is None else sets + others
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    values, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[number] > 1
    column = np.cumsum(times > 1) - 1
    number, owner = column[number[keep]], owner[keep]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    rows, total = len(sets), np.zeros((len(sets), len(both) - (0 if others is None else len(sets))), np.float32)
    width = 8192
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [low, low + width])
        there = np.zeros((len(both), width), np.float32)
        there[owner[a:b], number[a:b] - low] = 1
        total += there[:rows] @ (there[:rows] if others is None else there[rows:]).T
    return total


def banded(classes: DataFrame, threshold: float) -> DataFrame:
    """class_id, size, root and the block pairs (bands, i, j) in which the class is verified, with left and right.

    classes: class_id, size, n (of its set), root. Sets as near as the threshold lie in one band or in adjacent ones. bands
    is 2 b for a block pair of band b, and 2 b + 1 for a block of b against one of b + 1.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold + 1e-4)).cast("int")
    rows = classes.withColumn("band", band)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES)).cast("int")
    counts = rows.groupBy("root", "band").agg(blocks.alias("blocks"))
    own = counts.select("root", "band", F.col("blocks").alias("own"))
    above = counts.select("root", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    under = counts.select("root", (F.col("band") + 1).alias("band"), F.col("blocks").alias("under"))
    counts = own.join(above, ["root", "band"], "left").join(under, ["root", "band"], "left")
    rows = rows.join(counts, ["root", "band"]).withColumn("side", F.pmod(F.xxhash64("class_id"), F.col("own")).cast("int"))
    numbers = lambda c: F.when(F.col(c).isNotNull(), F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda bands, i, j, left, right: F.struct(bands.cast("int").alias("bands"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    side, yes, no = F.col("side"), F.lit(True), F.lit(False)
    same = F.transform(numbers("own"), lambda o: pair(2 * F.col("band"), F.least(side, o), F.greatest(side, o), side <= o, side >= o))
    lower = F.transform(numbers("above"), lambda o: pair(2 * F.col("band") + 1, side, o, yes, no))
    upper = F.transform(numbers("under"), lambda o: pair(2 * F.col("band") - 1, o, side, no, yes))
    return rows.select("class_id", "size", "root", F.explode(F.concat(same, lower, upper)).alias("p")).select("class_id", "size", "root", "p.*")


VERIFIED = "class_id long, links long, root long"


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """class_id, links (documents of linked classes) and root (a linked class, for spanning) for each block pair."""

    def verify(batches):
        for table in groups_of(batches, 4):
            keys = [table.column(k).to_numpy() for k in range(4)]
            ids, sizes, lefts, rights = (table.column(c).to_numpy() for c in ("class_id", "size", "left", "right"))
            data = table.column("shingles")
            at = starts_of(keys)
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for start, end in zip(at[:-1], at[1:], strict=True):
                left, right = np.flatnonzero(lefts[start:end]), np.flatnonzero(rights[start:end])
                if not len(left) or not len(right) or end - start < 2:
                    continue
                sets = [np.frombuffer(data[k].as_py(), np.uint64) for k in range(start, end)]
                n = np.array([len(s) for s in sets])
                one = bool((lefts[start:end] & rights[start:end]).all())
                common = overlaps([sets[k] for k in left], None if one else [sets[k] for k in right])
                linked = common >= threshold * (n[left][:, None] + n[right][None] - common) - 1e-6
                if one:
                    np.fill_diagonal(linked, False)
                links = np.zeros(end - start, np.int64)
                own = sizes[start:end]
                links[left] += linked @ own[right]
                if not one:
                    links[right] += linked.T @ own[left]
                order = np.argsort(ids[start:end], kind="stable")
                place = np.empty(end - start, np.int64)
                place[order] = np.arange(end - start)
                u, v = np.nonzero(linked)
                root = roots(end - start, place[left[u]], place[right[v]])
                far = links > 0
                out[0].append(ids[start:end][far])
                out[1].append(links[far])
                out[2].append(ids[start:end][order][root[place]][far])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["class_id", "links", "root"])

    key = ["root", "bands", "i", "j"]
    ordered = members.repartition(*key).sortWithinPartitions(*key)
    return ordered.select(*key, "class_id", "size", "left", "right", "shingles").transform(in_batches(verify, VERIFIED))


def with_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs with the column text replaced by shingles: the sorted 64-bit hashes of its set."""
    keep = [c for c in docs.columns if c != "text"]

    def fill(batches):
        for batch in batches:
            for first, texts in slices(batch.column(len(keep)), SLICE):
                hashes, offsets = unique_sets(*shingles(texts, size))
                data = [hashes[offsets[k] : offsets[k + 1]].tobytes() for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[:-1]), pa.array(data, pa.binary())], names=[*keep, "shingles"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "shingles binary"])
    return docs.select(*keep, "text").transform(in_batches(fill, schema))


def nodes(classes: DataFrame, trees: int, depth: int, floor: int) -> DataFrame:
    """class_id, tree, node: where the class's labels lie at the floor of each trie."""
    prefix = lambda t: F.substring("signature", 2 * depth * t + 1, 2 * floor)
    each: list[Column] = [F.struct(F.lit(t).alias("tree"), F.xxhash64(prefix(t)).alias("node")) for t in range(trees)]
    return classes.select("class_id", F.explode(F.array(*each)).alias("x")).select("class_id", "x.tree", "x.node")


def linked_rows(docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = 16, depth: int = 8, target: float = 0.9995) -> DataFrame:
    """row_key, class_id, group_id, n_links of each row of docs (row_key, text), where ids are row_keys."""
    marked = written(signed(docs, size, trees * depth), "signed")
    key = [F.when(F.col("signature").isNull(), F.col("row_key")).otherwise(F.col("key_a")).alias("key_a"), F.when(F.col("signature").isNull(), F.lit(None)).otherwise(F.col("key_b")).alias("key_b")]
    of = marked.select("row_key", *key, "n", "signature")
    # equal sets have one signature, so min takes any of them
    classes = written(of.groupBy("key_a", "key_b").agg(F.min("row_key").alias("class_id"), F.count("*").alias("size"), F.min("n").alias("n"), F.min("signature").alias("signature")), "classes")
    able = classes.filter(F.col("signature").isNotNull() & (F.col("n") >= threshold / (1 - threshold) - 1e-6))
    floor = floor_depth(threshold, trees, depth, target)
    spread_of = (threshold * (1 - threshold) * trees * depth) ** 0.5
    least_equal = int(threshold * trees * depth - 4 * spread_of)
    near = candidate_groups(able, trees, depth, floor, threshold, target, least_equal, PACKET)
    near = near.select(F.col("node").alias("class_id"), "root").union(near.select(F.col("root").alias("class_id"), "root").distinct())
    near = near.join(able.select("class_id", "size", "n"), "class_id")
    texts = docs.select(F.col("row_key").alias("class_id"), "text").join(near.select("class_id"), "class_id", "left_semi")
    sets = with_sets(texts, size)
    found = written(verified(banded(near, threshold).join(sets, "class_id"), threshold), "links")
    linked = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    out = classes.join(linked, "class_id", "left").join(grouped.select(F.col("node").alias("class_id"), F.col("root").alias("group_id")), "class_id", "left")
    out = out.select("key_a", "key_b", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    joined = of.alias("d").join(out.alias("c"), F.col("d.key_a").eqNullSafe(F.col("c.key_a")) & F.col("d.key_b").eqNullSafe(F.col("c.key_b")))
    return joined.select("row_key", "class_id", "group_id", "n_links")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """doc_id, class_id, group_id, n_links of each document.

    class_id: the smallest doc_id with the same shingle set. n_links: other documents whose Jaccard similarity
    is at least threshold. group_id: the smallest doc_id connected by such links.
    """
    docs, own = keyed(docs.select("doc_id", text_of().alias("text")))
    out = linked_rows(docs, threshold, size)
    if own:
        return out.withColumnRenamed("row_key", "doc_id")
    for name in ("row_key", "class_id", "group_id"):
        ids = docs.select(F.col("row_key").alias(name), F.col("doc_id").cast("long").alias(f"__{name}"))
        out = out.join(ids, name).drop(name)
    return out.select(F.col("__row_key").alias("doc_id"), F.col("__class_id").alias("class_id"), F.col("__group_id").alias("group_id"), "n_links")
