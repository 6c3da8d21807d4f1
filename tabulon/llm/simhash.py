"""Operator 9, document fingerprints: SimHash, and the search for near fingerprints. DataFrame functions only.

Each word is a term; its 64-bit hash votes for or against each bit with a weight that grows with the word's
length. Votes are sums: sixteen long columns hold four 16-bit counters each, so a word costs sixteen
additions in generated code, and counters can't run over because words are summed in runs of `RUN`.

Near fingerprints: 64 bits are cut into blocks; fingerprints within `radius` bits agree on all blocks but
`radius` of them. One table for each choice of agreeing blocks is keyed by those blocks (a permutation
that puts them first); only fingerprints that share a key are compared, each pair in the first table that
holds both. Members of a key are compared in packets of `PACKET`, so no row exists for a pair.

Defined cases: a null text is empty; an empty text has fingerprint 0; each row is a document of its own, also where
doc_ids repeat or are null (in descending order those without one come first); a very long text is one row's string,
its words are summed in runs; an empty table gives no rows; a single document is its own next; other columns of the
input are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import keyed, text_of
from tabulon.sources.shared import written

#: 3 * RUN must stay below 2^15: the top counter ends at the sign bit.
RUN = 8_192
PACKET = 256
LANES = 0x0001000100010001


def unsigned_shift(c: Column, by: int) -> Column:
    return F.shiftrightunsigned(c, by) if by else c


def votes(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key and fingerprint (long) of each row's text; key columns must tell rows apart."""
    words = F.split(F.translate(F.lower(text), "\n\t\r\u000b\u000c", " " * 5), " ")
    each = texts.select(*key, F.posexplode(words).alias("__at", "__word"))
    size = F.length("__word")
    weight = F.when(size == 0, 0).when(size <= 3, 1).when(size <= 6, 2).otherwise(3).cast("long")
    each = each.select(*key, F.floor(F.col("__at") / RUN).cast("int").alias("__run"), F.xxhash64("__word").alias("__h"), weight.alias("__w"))
    sums = [F.sum(F.expr(f"(shiftrightunsigned(__h, {j}) & {LANES}L) * __w")).alias(f"__s{j}") for j in range(16)]
    runs = each.groupBy(*key, "__run").agg(*sums, F.sum("__w").alias("__total"))
    unpack = [F.sum(F.expr(f"shiftrightunsigned(__s{b % 16}, {16 * (b // 16)}) & 65535L")).alias(f"__b{b}") for b in range(64)]
    totals = runs.groupBy(*key).agg(*unpack, F.sum("__total").alias("__total"))
    bits = [F.when(F.col(f"__b{b}") * 2 > F.col("__total"), F.expr(f"shiftleft(1L, {b})")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    fingerprint = bits[0]
    for b in bits[1:]:
        fingerprint = fingerprint.bitwiseOR(b)
    return totals.select(*key, fingerprint.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def successors(rows: DataFrame) -> DataFrame:
    """row_key, next_key: the next in descending order, after the last the first; row_keys are distinct."""
    ordered = rows.repartitionByRange("row_key").sortWithinPartitions("row_key")
    at = F.monotonically_increasing_id()
    ordered = written(ordered.select("row_key", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "order")
    parts = sorted(ordered.groupBy("part").count().collect())  # one row for each partition of the sort
    before, total = {}, 0
    for part, n in parts:
        before[part], total = total, total + n
    if not total:
        return rows.select("row_key", F.col("row_key").alias("next_key"))
    starts = rows.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    placed = ordered.join(F.broadcast(starts), "part").select("row_key", (F.col("at") + F.col("before")).alias("place"))
    after = placed.select(F.col("row_key").alias("next_key"), F.pmod(F.col("place") + 1, F.lit(total)).alias("place"))
    return placed.join(after, "place").select("row_key", "next_key")


def near_counts(fingerprints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """fingerprint, n_near: for each distinct fingerprint with any, the number of others within radius bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("m")) for t, m in enumerate(masks)))).alias("c")
    rows = fingerprints.select("fingerprint").distinct().select("fingerprint", tables)
    rows = rows.select("fingerprint", F.col("c.t").alias("t"), F.col("fingerprint").bitwiseAND(F.col("c.m")).alias("key"))
    # counts by aggregate and packets by hash, so that no task holds all fingerprints of a key
    several = rows.groupBy("t", "key").agg(F.ceil(F.count("*") / PACKET).cast("int").alias("packets"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(several, ["t", "key"]).withColumn("packet", F.pmod(F.xxhash64("fingerprint"), F.col("packets")).cast("int"))
    packets = rows.groupBy("t", "key", "packet").agg(F.collect_list("fingerprint").alias("them"))

    def earlier(t: Column, a: Column, b: Column) -> Column:
        """True where a table before t holds both."""
        differ = a.bitwiseXOR(b)
        own = F.lit(False)
        for k, m in enumerate(masks[:-1]):
            own = own | ((t > k) & (differ.bitwiseAND(F.lit(m).cast("long")) == 0))
        return own

    def near(t: Column, a: Column, b: Column) -> Column:
        return (F.bit_count(a.bitwiseXOR(b)) <= radius) & (a != b) & ~earlier(t, a, b)

    met = packets.alias("a").join(packets.select("t", "key", F.col("them").alias("others")).alias("b"), ["t", "key"])
    found = met.select(F.explode(F.transform("them", lambda a: F.struct(a.alias("fingerprint"), F.size(F.filter("others", lambda b: near(F.col("t"), a, b))).alias("n")))).alias("r"))
    return found.filter("r.n > 0").groupBy("r.fingerprint").agg(F.sum("r.n").cast("long").alias("n_near"))


def edited_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Each document's fingerprint and that of its edited text: its last third replaced by the next document's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_near: how many
    other fingerprints of documents are within radius bits.
    """
    docs, _ = keyed(docs.select("doc_id", text_of().alias("text")))
    ids, docs = docs.select("row_key", "doc_id"), docs.select("row_key", "text")  # with equal columns both joins below use one shuffle of the texts
    order = successors(docs.select("row_key"))
    third = lambda n: F.floor(n / 3).cast("int")
    sizes = order.join(docs.select("row_key", F.length("text").alias("n")), "row_key").select(F.col("row_key").alias("before_key"), F.col("next_key").alias("row_key"), "n")
    heads = docs.join(sizes, "row_key").select(F.col("before_key").alias("row_key"), F.left("text", third(F.col("n"))).alias("head"))
    n = F.length("text")
    key = ["row_key", "n_chars", "edited_sha256", "which"]
    both = docs.join(heads, "row_key").select("row_key", n.cast("long").alias("n_chars"), "text", F.concat(F.left("text", n - third(n)), "head").alias("edited"))
    versions = F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v")
    both = both.select("row_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), versions)
    marks = written(votes(both.select(*key[:-1], "v.which", "v.text"), key, "text"), "fingerprints")
    own, edited = marks.filter("which = 0"), marks.filter("which = 1").select("row_key", F.col("fingerprint").alias("edited"))
    nexts = own.select(F.col("row_key").alias("next_key"), F.col("fingerprint").alias("following"))
    near = written(near_counts(own, radius), "near")  # a table by itself: joined to an aggregate, a fingerprint of many copies could not be split
    joined = own.join(edited, "row_key").join(order, "row_key").join(ids, "row_key").join(nexts, "next_key").join(near, "fingerprint", "left")
    near_edited, near_next = (likeness(F.col("fingerprint"), F.col(c)) for c in ("edited", "following"))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fingerprint")).alias("fingerprint"), hexed(F.col("edited")).alias("edited_fingerprint"),
        near_edited.alias("near_edited"), near_next.alias("near_next"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
