"""Near-duplicate keys: fuzzy, reordered, or sharing an identifier; exact at any size.

Strings at most k edits apart share a string that at most k deletions from each give. Long strings make too many of
those, so they meet by segments: a string is cut into k + 1 pieces, and of two strings within k edits one holds a piece
of the other at most k places away. Where many strings hold a piece (a common prefix), what is left of the strings without
that piece is at most k edits apart, too, so they must share a piece of that as well, and so on.
Candidates come from equal marks, and the bounded distance decides. Texts travel as hashes until then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import blank, strip, with_keys, within_distance
from tabulon.operators.profile import ROW, headers
from tabulon.sources.shared import written

SIGNALS = ("key_fuzzy", "token_reorder", "shared_identifier")
SHORT = 12
#: Strings that hold one piece before a second one is asked for.
CROWDED = 32


def keyed_rows(sheet: DataFrame, key: str) -> DataFrame:
    """__row, value, ckey, signature, dkey of rows whose key is not blank. Equal dkeys have equal ckeys, and those equal signatures."""
    cell = F.col(f"`{key}`")
    return with_keys(sheet.filter(~blank(cell)).select(ROW, strip(cell).alias("value")), "value").select(ROW, "value", "ckey", "signature", "dkey")


def deletions(c: Column, k: int) -> Column:
    """All strings that at most k deletions give."""
    out = F.array(c)
    for _ in range(k):
        shorter = F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def _placed(strings: DataFrame, k: int) -> DataFrame:
    """strings with at, len and m of each of the k + 1 pieces of s: m hashes the length of s, the piece's number and text."""
    rows = strings.select("*", F.length("s").alias("n"), F.explode(F.array(*map(F.lit, range(k + 1)))).alias("p"))
    rows = rows.withColumn("at", F.expr(f"cast(n * p div {k + 1} as int)")).withColumn("len", F.expr(f"cast(n * (p + 1) div {k + 1} as int) - at"))
    return rows.withColumn("m", F.expr("xxhash64(n, p, substring(s, at + 1, len))")).drop("p")


def _probed(strings: DataFrame, k: int, n: str | None = None) -> DataFrame:
    """strings with n, at, len and m: what the pieces of strings at most k edits away would be in s.

    n: a column with the length of those strings, where it is known.
    """
    choices = [F.struct(F.lit(more).alias("more"), F.lit(p).alias("p"), F.lit(shift).alias("shift")) for more in (range(-k, k + 1) if n is None else (0,)) for p in range(k + 1) for shift in range(-k, k + 1)]
    rows = strings.select("*", F.explode(F.array(*choices)).alias("c")).withColumn("n", F.length("s") + F.col("c.more") if n is None else F.col(n))
    rows = rows.withColumn("start", F.expr(f"cast(n * c.p div {k + 1} as int)")).withColumn("len", F.expr(f"cast(n * (c.p + 1) div {k + 1} as int) - start"))
    rows = rows.withColumn("at", F.expr("start + c.shift")).filter("at >= 0 and at + len <= length(s)")
    return rows.withColumn("m", F.expr("xxhash64(n, c.p, substring(s, at + 1, len))")).drop("c", "start")


def _met_by_pieces(strings: DataFrame, k: int, levels: int = 6) -> DataFrame:
    """x, y: ids of strings (id, s) that may be at most k edits apart.

    Each level asks for one more shared piece where too many strings hold all that were asked for so far.
    """
    rest = F.expr("concat(substring(s, 1, at), substring(s, at + len + 1, length(s)))").alias("s")
    key = F.xxhash64("outer", "m").alias("m")
    strings = strings.select("id", "s", F.lit(0).cast("long").alias("outer"))
    held, asked, met = _placed(strings, k), _probed(strings, k), None
    for level in range(levels):
        holders, askers = held.select("id", key), asked.select("id", key)
        crowded = written(holders.groupBy("m").agg(F.count("*").alias("c")).filter(F.col("c") > CROWDED).select("m"), "crowded")
        more = level + 1 < levels and crowded.limit(1).count()
        found = (holders.join(crowded, "m", "left_anti") if more else holders).alias("h").join(askers.distinct().alias("a"), "m")
        found = found.filter("h.id <> a.id").select(F.col("h.id").alias("x"), F.col("a.id").alias("y"))
        met = found if met is None else met.union(found)
        if not more:
            return met
        left = lambda rows: rows.withColumn("m", key).join(crowded, "m", "left_semi")
        held = _placed(written(left(held).select("id", F.col("m").alias("outer"), rest), "held"), k)
        asked = _probed(written(left(asked).select("id", F.col("m").alias("outer"), (F.col("n") - F.col("len")).alias("left"), rest).distinct(), "asked"), k, "left")


def close_strings(strings: DataFrame, column: str, k: int = 2) -> DataFrame:
    """a, b, distance: pairs a < b of distinct strings at most k edits apart."""
    distinct = written(strings.select(F.col(column).alias("s")).distinct().select(F.md5("s").alias("id"), "s"), "strings")
    short = distinct.filter(F.length("s") <= SHORT + k).select("id", F.explode(deletions(F.col("s"), k)).alias("m")).select("id", F.xxhash64("m").alias("m"))
    pairs = short.alias("h").join(short.alias("a"), "m").filter("h.id < a.id").select(F.col("h.id").alias("x"), F.col("a.id").alias("y"))
    pairs = pairs.union(_met_by_pieces(distinct.filter(F.length("s") > SHORT), k)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    texts = lambda name: distinct.select(F.col("id").alias(name), F.col("s").alias(f"s{name}"))
    both = pairs.join(texts("x"), "x").join(texts("y"), "y").filter(within_distance(F.col("sx"), F.col("sy"), k))
    return both.select(F.least("sx", "sy").alias("a"), F.greatest("sx", "sy").alias("b"), F.levenshtein("sx", "sy", k).alias("distance"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """a_row < b_row of pairs of rows with different duplicate keys."""
    return pairs.filter("a_dkey <> b_dkey").select(F.least("a_row", "b_row").alias("a_row"), F.greatest("a_row", "b_row").alias("b_row")).distinct()


def _side(rows: DataFrame, side: str, by: str) -> DataFrame:
    return rows.select(F.col(ROW).alias(f"{side}_row"), F.col("dkey").alias(f"{side}_dkey"), F.col(by).alias(side))


def fuzzy_pairs(rows: DataFrame, k: int = 2) -> DataFrame:
    """a_row, b_row whose comparison keys are at most k edits apart, equal ones included."""
    keys = close_strings(rows, "ckey", k).select(F.md5("a").alias("a"), F.md5("b").alias("b"))
    rows = rows.withColumn("ckey", F.md5("ckey"))
    a, b = _side(rows, "a", "ckey"), _side(rows, "b", "ckey")
    apart = keys.join(a, "a").join(b, "b")
    same = a.join(b.withColumnRenamed("b", "a"), "a").filter("a_row < b_row")
    columns = ["a_row", "a_dkey", "b_row", "b_dkey"]
    return _ordered(apart.select(*columns).union(same.select(*columns)))


def reordered_pairs(rows: DataFrame) -> DataFrame:
    """a_row, b_row whose keys have the same words."""
    a, b = _side(rows, "a", "signature"), _side(rows, "b", "signature").withColumnRenamed("b", "a")
    return _ordered(a.join(b, "a").filter("a_row < b_row"))


def identifier_pairs(sheet: DataFrame, key: str, identifiers: list[str]) -> DataFrame:
    """a_row, b_row, field: each later row with the first row that holds the same identifier."""
    rows = keyed_rows(sheet, key).select(ROW, "dkey")
    found = None
    for field in identifiers:
        values = sheet.select(ROW, strip(F.col(f"`{field}`")).alias("v")).filter("v <> ''").join(rows, ROW)
        first = values.groupBy("v").agg(F.min_by(F.struct(ROW, "dkey"), ROW).alias("first"))
        later = values.join(first, "v").filter((F.col(ROW) > F.col(f"first.{ROW}")) & (F.col("dkey") != F.col("first.dkey")))
        own = later.select(F.col(f"first.{ROW}").alias("a_row"), F.col(ROW).alias("b_row"), F.lit(field).alias("field"))
        found = own if found is None else found.union(own)
    return found if found is not None else sheet.sparkSession.createDataFrame([], "a_row long, b_row long, field string")


def pair_count(sheet: DataFrame, key: str, identifiers: list[str], k: int = 2) -> DataFrame:
    """n: how many pairs near_duplicate_pairs lists, from counts of classes; pairs of a class are never listed.

    Rows with one comparison key are a class; classes with one signature are a group. Pairs of near classes and those that
    share an identifier are listed by class or row, and count where no broader rule holds.
    """
    rows = keyed_rows(sheet, key)
    rows = written(rows.select(ROW, "ckey", F.md5("ckey").alias("c"), F.md5("signature").alias("s"), F.md5("dkey").alias("d")), "keyed")
    kinds = rows.groupBy("s", "c", "d").agg(F.count("*").alias("n"))
    classes = written(kinds.groupBy("s", "c").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")), "classes")
    inside = classes.select(F.expr("(n * n - same) div 2").alias("n"))
    groups = classes.groupBy("s").agg(F.expr("(sum(n) * sum(n) - sum(n * n)) div 2").alias("n")).select("n")
    close = written(close_strings(rows, "ckey", k).select(F.md5("a").alias("a"), F.md5("b").alias("b")), "close")
    side = lambda x: classes.select(F.col("c").alias(x), F.col("s").alias(f"s_{x}"), F.col("n").alias(f"n_{x}"))
    apart = close.join(side("a"), "a").join(side("b"), "b").filter("s_a <> s_b")
    near = apart.select((F.col("n_a") * F.col("n_b")).alias("n"))
    shared = identifier_pairs(sheet, key, identifiers).select("a_row", "b_row").distinct()
    of = lambda x: rows.select(F.col(ROW).alias(f"{x}_row"), F.col("c").alias(x), F.col("s").alias(f"s_{x}"))
    shared = shared.join(of("a"), "a_row").join(of("b"), "b_row").filter("s_a <> s_b")
    shared = shared.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).join(close.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), ["x", "y"], "left_anti")
    every = inside.union(groups).union(near).union(shared.agg(F.count("*").alias("n")))
    return every.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def near_duplicate_pairs(sheet: DataFrame, key: str, identifiers: list[str], compare: list[str] | None = None, k: int = 2) -> DataFrame:
    """a_row, a_value, b_row, b_value, edit_distance, signals, shared_fields, differing_fields; no cap, no size guard."""
    rows = keyed_rows(sheet, key)
    none = F.lit(None).cast("string")
    signals = (
        fuzzy_pairs(rows, k).select("a_row", "b_row", F.lit(0).alias("signal"), none.alias("field"))
        .union(reordered_pairs(rows).select("a_row", "b_row", F.lit(1), none))
        .union(identifier_pairs(sheet, key, identifiers).select("a_row", "b_row", F.lit(2), "field"))
    )
    pairs = signals.groupBy("a_row", "b_row").agg(F.array_sort(F.collect_set("signal")).alias("s"), F.array_sort(F.collect_set("field")).alias("shared_fields"))
    others = [h for h in (compare if compare is not None else headers(sheet)) if h != key and h in sheet.columns]
    cells = F.array(*(strip(F.col(f"`{h}`")) for h in others)) if others else F.array().cast("array<string>")
    full = sheet.select(ROW, cells.alias("cells")).join(rows.select(ROW, "value", "ckey"), ROW)
    side = lambda x: full.select(F.col(ROW).alias(f"{x}_row"), F.col("value").alias(f"{x}_value"), F.col("ckey").alias(f"{x}_ckey"), F.col("cells").alias(f"{x}_cells"))
    both = pairs.join(side("a"), "a_row").join(side("b"), "b_row")
    differing = F.array_compact(F.array(*(F.when(F.get("a_cells", F.lit(i)) != F.get("b_cells", F.lit(i)), h) for i, h in enumerate(others)))) if others else F.array().cast("array<string>")
    names = F.transform("s", lambda i: F.array(*map(F.lit, SIGNALS))[i])
    return both.select("a_row", "a_value", "b_row", "b_value", F.levenshtein("a_ckey", "b_ckey").alias("edit_distance"), names.alias("signals"), "shared_fields", differing.alias("differing_fields"))
