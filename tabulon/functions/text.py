"""Normalisation, comparison keys and small text functions.

Null and empty are the same everywhere: functions of a null give what they give for ''.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Company-form tokens that a comparison key drops.
COMPANY_FORMS = ("pte", "ltd", "llc", "inc", "co", "corp", "limited", "plc", "sdn", "bhd", "berhad")

# The characters that count as white space at the ends of a cell.
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def filled(c: Column | str) -> Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without any white space at the ends; trim alone takes spaces only."""
    return F.btrim(filled(c), F.lit(WHITE_SPACE))


def blank(c: Column | str) -> Column:
    return strip(c) == ""


@functools.cache
def foldings() -> tuple[str, str, dict[str, str]]:
    """(lower-case letters with a single other folding, those foldings, letters that fold to several), by Unicode's rule."""
    other = {c: c.casefold() for c in map(chr, range(0x110000)) if c.lower() == c != c.casefold()}
    one = {c: f for c, f in other.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in other.items() if len(f) > 1}


@functools.cache
def _other_letters() -> str:
    """A pattern's class of the lower-case letters with another folding, as ranges."""
    single, _, several = foldings()
    ranges: list[list[int]] = []
    for k in sorted(map(ord, [*single, *several])):
        if ranges and ranges[-1][1] == k - 1:
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
    return "[\\x{80}-\\x{10ffff}&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]]"


def casefold(c: Column | str) -> Column:
    """Full case folding. Letters with another folding than their lower case are rare: a text is cut at those, and only they are looked up."""
    single, to, several = foldings()
    low, other = F.lower(filled(c)), _other_letters()
    table = F.create_map(*(F.lit(x) for pair in [*zip(single, to, strict=True), *several.items()] for x in pair))
    pieces = F.split(low, f"(?<={other})|(?={other})")
    apart = F.array_join(F.transform(pieces, lambda x: F.when(F.length(x) == 1, F.coalesce(F.try_element_at(table, x), x)).otherwise(x)), "")
    return F.when(low.rlike(other), apart).otherwise(low)


def duplicate_key(c: Column | str) -> Column:
    """What duplicate groups share."""
    return casefold(strip(c))


def norm(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", "")


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(filled(c)), "[^a-z0-9]+"), lambda t: t != "")


def _spaced(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]++", " "))


def spaced(c: Column | str) -> Column:
    """Case-folded runs of letters and digits of any script, one space apart."""
    return _spaced(casefold(c))


def _without_forms(plain: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), " (?:" + "|".join(COMPANY_FORMS) + ")(?= )", ""))


def compare_key(c: Column | str) -> Column:
    """Words without company forms; a value of nothing but company forms keeps them."""
    plain = spaced(c)
    kept = _without_forms(plain)
    return F.when(kept == "", plain).otherwise(kept)


def with_keys(rows: DataFrame, value: str) -> DataFrame:
    """rows with dkey, ckey and signature: the case-folded, the comparison key and the token signature of the stripped column `value`.

    Each comes from the one before, column by column, so a text is folded and searched once.
    """
    rows = rows.withColumn("dkey", casefold(value)).withColumn("__plain", _spaced(F.col("dkey"))).withColumn("__kept", _without_forms(F.col("__plain")))
    rows = rows.withColumn("ckey", F.when(F.col("__kept") == "", F.col("__plain")).otherwise(F.col("__kept"))).drop("__plain", "__kept")
    return rows.withColumn("signature", F.array_join(F.sort_array(F.split("ckey", " ")), " "))


def token_signature(c: Column | str) -> Column:
    return F.array_join(F.sort_array(F.split(compare_key(c), " ")), " ")


def snake(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(strip(c), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def loose(c: Column | str) -> Column:
    """Letters and digits only: how a header label meets a derived field name."""
    return F.regexp_replace(F.lower(filled(c)), r"[^\p{L}\p{N}]", "")


def within_distance(a: Column, b: Column, k: int) -> Column:
    """At most k edits apart; the length test is cheap, the bounded distance stops early."""
    near = F.abs(F.length(a) - F.length(b)) <= k
    return near & (F.levenshtein(a, b, k) >= 0)


def split_name(c: Column | str) -> Column:
    """struct<first, last>, cut at the first space."""
    parts = F.split(strip(c), " ", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("first"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("last"))


def error_message(c: Column | str) -> Column:
    """The short message in a server's error body, else the body."""
    body, out = filled(c), None
    for key in ("exception", "message"):
        pattern = rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*+)"'
        found = F.from_json(F.concat(F.lit('{"m":"'), F.regexp_extract(body, pattern, 1), F.lit('"}')), "m string")["m"]
        value = F.coalesce(found, F.regexp_extract(body, pattern, 1))
        out = F.when(body.rlike(pattern), value) if out is None else out.when(body.rlike(pattern), value)
    return out.otherwise(body)


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once: a lambda's body works out anew, for each element, what it names from outside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract_json(c: Column | str) -> Column:
    """The first balanced {...} in a reply that parses, else null; fences and prose around it are skipped.

    Candidates start at each '{' and end at the '}' that balances it. The text is cut at braces; one walk over the pieces
    pairs them, and candidates are tried in the order of their starts until one parses.
    """
    text = F.regexp_replace(strip(c), r"(?m)^```(?:json)?\s*|\s*```$", "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<start:int,end:int>>").alias("pairs"))

    def step(a: Column, x: Column) -> Column:
        at, closes = a["at"] + F.length(x), (x == "}") & (F.size(a["open"]) > 0)
        opened = F.when(x == "{", F.concat(a["open"], F.array(at))).when(closes, F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1)).otherwise(a["open"])
        pair = F.struct(F.element_at(a["open"], F.lit(-1)).alias("start"), at.alias("end"))
        return F.struct(at.alias("at"), opened.alias("open"), F.when(closes, F.concat(a["pairs"], F.array(pair))).otherwise(a["pairs"]).alias("pairs"))

    def first(t: Column) -> Column:
        pairs = F.array_sort(F.aggregate(F.split(t, r"(?<=[{}])|(?=[{}])"), start, step, lambda a: a["pairs"]))
        taken = lambda o: F.when(F.try_parse_json(o).isNotNull(), o)
        tried = lambda a, p: F.when(a.isNotNull(), a).otherwise(_once(F.substring(t, p["start"], p["end"] - p["start"] + 1), taken))
        return F.aggregate(pairs, F.lit(None).cast("string"), tried)

    return _once(text, first)
