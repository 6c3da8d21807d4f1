"""Operator 6, PII by weak supervision, in DataFrame functions only.

1. Candidates. One regular expression for each source marks its matches in the text; their places follow from the
   lengths of the parts between the marks. The base rules give four kinds; wider sources add what they miss: addresses
   spelt with (at) and (dot), numbers without a country's code, long tokens that could be secrets, pairs of capitalised words.
2. Labelers vote on each candidate: form (regex), gazetteer, cue words to the left and to the right (context),
   what touches it, and cue words that are learned: over all documents the words next to matches of the base rules (of
   kinds without one, next to what the gazetteer names) are counted, and a word that is there far more often than next
   to candidates at large speaks for that kind. A vote is 1, -1 or 0 (abstains).
3. The counts of each pattern of votes, over all documents, feed an expectation-maximisation that estimates for each
   kind how each labeler votes on personal data and on the rest. Matches of the base rules are known examples.
4. A logistic span classifier is fitted to the probabilities of a bounded sample of candidates. Its features are its own, beside
   the votes: length, shares of digits and capitals, separators, the characters and the words next to the span. It
   decides on the candidates beyond the base rules; matches of the base rules always stay.

What is collected is one row for each pattern of votes, at most kinds x 2 x 3 ^ labelers, one for each kind and
bucket of neighbouring words, and the sample.

Loops over groups in Java's regular expressions recurse and overflow on long texts, so repeated
groups are written as single character classes over a text whose inner separators are marked first,
one character for one character. The control characters used as marks count as other characters.

Defined cases: null and empty texts have no spans; rows are judged each, also where doc_ids repeat or are null; a very long
text is one row's string; an empty table gives no rows and trains nothing; other columns of the input are ignored; places
are code points.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import text_of
from tabulon.sources.shared import written

BASE = ("email", "ip", "card", "phone")
#: All kinds, in the order in which spans with one start are listed.
KINDS = (*BASE, "secret", "person")
#: Where candidates come from, with their kind.
SOURCES = {**{k: k for k in KINDS}, "spelt_email": "email", "local_phone": "phone"}
LABELERS = ("form", "gazetteer", "left", "right", "edge", "learned")
#: Those that vote as candidates are found; what is learned comes after.
AT_ONCE = LABELERS[:-1]
#: Buckets of words next to a candidate, and how much more often than elsewhere a learned cue is there.
CUE_BUCKETS, CUE_RATIO, CUE_LEAST = 4096, 8.0, 8
#: The classifier's own features, with how many values each has.
FEATURES = {"size": 8, "digits": 5, "capitals": 5, "separators": 5, "before": 7, "after": 7, "word_before": 32, "word_after": 32}

# Gazetteers and cue words.
TOP_DOMAINS = ["com", "net", "org", "edu", "gov", "mil", "int", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl", "be"]
SECRET_NAMES = ["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "private_key", "client_secret"]
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr", "Sra"]
GIVEN_NAMES = ["Anna", "Carlos", "Claire", "Daniel", "David", "Emma", "Hans", "James", "Jean", "John", "Juan", "Julia", "Karl", "Laura", "Lucia", "Maria", "Marie", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Thomas", "William"]
FUNCTION_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "der", "die", "das", "und", "ist", "von", "le", "la", "les", "de", "et", "est", "el", "los", "y", "que", "un", "une"]
NO_NAMES = ["License", "Licence", "Public", "General", "Commons", "Software", "Foundation", "University", "Institute", "Street", "Road", "Avenue", "Company", "Limited", "New", "United", "North", "South", "East", "West", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
CUES = {
    "email": ["mail", "e-mail", "contact", "write", "correo", "courriel", "kontakt", "reach"],
    "ip": ["ip", "server", "host", "address", "from", "addr", "login"],
    "card": ["card", "visa", "credit", "payment", "karte", "carte", "tarjeta", "pay"],
    "phone": ["phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone", "ring"],
    "secret": ["key", "login", "auth", "credential", "bearer", "password", "token", "secret"],
    "person": ["name", "by", "from", "signed", "contact", "author", "ask", "dear"],
}
AGAINST = ["version", "release", "section", "chapter", "isbn", "commit", "sha", "checksum", "build", "order", "page", "figure"]

MARK, DOT, JOIN, OTHER = "\u0001", "\u0003", "\u0004", "\u0002"
LOCAL = rf"[A-Za-z0-9._%+{DOT}-]"
_TOKEN = r"[A-Za-z0-9+/_-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{JOIN}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # what follows a secret's name, or any long token with letters and digits
    "secret": rf"(?i)(?<=(?:{'|'.join(SECRET_NAMES)})\x20?[=:]\x20?[\"']?){_TOKEN}{{8,}}+|(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){_TOKEN}{{16,}}+(?![@.])",
    "person": rf"(?<![A-Za-z])(?!(?:{'|'.join(TITLES)})\.?\x20)[A-Z][a-z]{{1,20}}+\x20[A-Z][a-z]{{1,20}}+",
    "spelt_email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,64}+\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,10}+",
    "local_phone": r"(?<![0-9+.(-])(?<!\+[0-9]{1,3}[\x20.-])(?<![0-9][\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def prepared(source: str, text: Column) -> Column:
    """The text with inner separators marked, as long as before."""
    text = F.translate(text, MARK + DOT + JOIN, OTHER * 3)
    if source == "email":
        return F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    if source == "card":
        return F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", JOIN)
    return text


def possible(source: str, text: Column) -> Column:
    """False only where the source can't match; cheaper than its pattern."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][0-9\x20-]{12,}+"),
        "phone": text.contains("+"),
        "secret": text.rlike(r"[0-9]|[=:]"),
        "person": text.rlike(r"[a-z]\x20[A-Z][a-z]"),
        "spelt_email": text.rlike(r"(?i)at[)\]\x20]"),
        "local_phone": text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    }[source]


def passes(source: str, match: Column) -> Column:
    """The base rule's further conditions; other sources have none."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    return {
        "ip": match.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"),
        "card": F.length(digits).between(14, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(10, 15),
    }.get(source, F.lit(True))


def vote(yes: Column, no: Column | None = None) -> Column:
    return (F.when(yes, 1) if no is None else F.when(yes, 1).when(no, -1)).otherwise(0).cast("byte")


def any_of(words: list[str]) -> str:
    return "(?i)(?<![a-z])(?:" + "|".join(words) + ")(?![a-z])"


def votes(kind: str, match: Column, left: Column, right: Column) -> list[Column]:
    """What AT_ONCE say about a match."""
    titled = r"(?<![A-Za-z])(?:" + "|".join(TITLES) + r")\.?\x20$"
    first, second = F.substring_index(match, " ", 1), F.substring_index(match, " ", -1)
    form = {
        "email": vote(match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@|[(\[](?i:at)[)\]]"), match.contains("..") | match.rlike(r"(?i)\x20at\x20")),
        "ip": vote(match.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$")),
        "card": vote(F.length(F.regexp_replace(match, "[^0-9]", "")).between(15, 16), F.lit(True)),
        "phone": vote(match.rlike(r"^\+[0-9]{1,3}[\x20(]|^\([0-9]{3}\)|^([0-9]{3})([\x20.-])[0-9]{3}\2"), ~match.startswith("+")),
        "secret": vote(match.rlike(r"^(?:AKIA|ghp_|gho_|sk-|xox)|^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20}"), match.rlike(r"^[A-Za-z]+[-_]?[0-9]{1,4}$|^[0-9a-f]{8}-[0-9a-f]{4}-|^[0-9-]+$|/.*/|^[A-Za-z]+[0-9]*(?:[-_][A-Za-z0-9]{1,8}){3}")),
        "person": vote(left.rlike(titled), (first == second) | (F.length(first) < 3) | (F.length(second) < 3)),
    }[kind]
    words = r"(?i)^(?:" + "|".join(FUNCTION_WORDS) + r")(?:\x20|$)|\x20(?:" + "|".join(FUNCTION_WORDS) + r")$"
    listed = {
        "email": vote(match.rlike(r"(?i)(?:\.|[)\]\x20])(?:" + "|".join(TOP_DOMAINS) + ")$"), F.lit(True)),
        "ip": vote(~match.rlike(r"^(?:0|127|255)\."), F.lit(True)),
        "card": vote(match.rlike("^[3-6]")),
        "phone": vote(match.rlike(r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\(?[2-9]"), F.lit(True)),
        "secret": vote(left.rlike(r"(?i)(?:" + "|".join(SECRET_NAMES) + r")\x20?[=:]\x20?[\"']?$")),
        "person": vote(first.isin(*GIVEN_NAMES), match.rlike(words) | first.isin(*NO_NAMES) | second.isin(*NO_NAMES)),
    }[kind]
    cues = any_of(CUES[kind])
    near = left.rlike(cues[:-len("(?![a-z])")] + r"(?![a-z])[^A-Za-z]{0,4}$") if kind == "person" else left.rlike(cues)
    after = {"person": right.rlike(r"^\x20(?:wrote|said|called|lives|was\x20born)|^'s\x20"), "secret": right.rlike(r"^[\"']")}.get(kind, right.rlike(cues))
    edge = {
        # a run of capitalised words is a headline, not a name
        "person": vote(left.rlike(r"[a-z,:]\x20$") & right.rlike(r"^(?:[.,;]|\x20[a-z])"), (~left.rlike(titled) & left.rlike(r"(?<![A-Za-z])[A-Z][a-z]*\x20$|(?:^|[.!?\n][\x20\n]*)$")) | right.rlike(r"^\x20[A-Z]")),
        "secret": vote(F.size(F.array_distinct(F.split(match, ""))) >= 9, F.size(F.array_distinct(F.split(match, ""))) < 7),
    }.get(kind, vote(~left.rlike(r"[\w]$") & ~right.rlike(r"^[\w]"), left.rlike(r"[0-9]\.?$") | right.rlike(r"^\.?[0-9]")))
    return [form, listed, vote(near, left.rlike(any_of(AGAINST))), vote(after), edge]


def features(match: Column, left: Column, right: Column) -> list[Column]:
    """What the classifier sees, as numbers below FEATURES."""
    share = lambda what: F.least(F.floor(5 * F.length(F.regexp_replace(match, what, "")) / F.greatest(F.length(match), F.lit(1))), F.lit(4))
    kind_of = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[\"'`]"), 2).when(c.rlike("[=:]"), 3).when(c.rlike("[.,;!?]"), 4).when(c.rlike(r"\w"), 5).otherwise(6)
    before, after, _ = neighbours(left, right)
    return [
        F.least(F.floor(F.log2(F.greatest(F.length(match), F.lit(1)))), F.lit(7)), share("[^0-9]"), share("[^A-Z]"), F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(4)),
        kind_of(F.right(left, F.lit(1))), kind_of(F.left(right, F.lit(1))), before % 32, after % 32,
    ]


def neighbours(left: Column, right: Column) -> tuple[Column, Column, Column]:
    """The buckets of the words before and after a candidate, and of one that stands further off; 0 where there is none."""

    def bucket(c: Column, pattern: str) -> Column:
        word = F.lower(F.regexp_extract(c, pattern, 1))
        return F.when(word == "", 0).otherwise(F.pmod(F.crc32(word.cast("binary")), F.lit(CUE_BUCKETS - 1)) + 1).cast("short")

    return bucket(left, r"(\p{L}++)\P{L}*+$"), bucket(right, r"^\P{L}*+(\p{L}++)"), bucket(left, r"^\S*+\s++\P{L}*+(\p{L}++)\s")


NAMES = (*LABELERS, *FEATURES)
FOUND = (*AT_ONCE, *FEATURES)
TYPE = "array<struct<kind:tinyint,start:int,stop:int,base:boolean," + ",".join(f"{x}:tinyint" for x in FOUND) + ",cue_before:smallint,cue_after:smallint,cue_far:smallint>>"


def candidates(text: Column, source: str, reach: int = 32) -> Column:
    """array<struct<kind, start, stop, base, votes..., features...>> of one source, in order."""
    parts, kind = F.split(F.regexp_replace(prepared(source, text), PATTERNS[source], f"{MARK}$0{MARK}"), MARK), SOURCES[source]

    def from_parts(parts: Column) -> Column:
        ends = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
            lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["ends"], F.array(a["at"] + F.length(p))).alias("ends")),
        )["ends"]

        def one(both: Column, i: Column) -> Column:
            parts, ends = both["parts"], both["ends"]
            match, left = F.translate(parts[i], DOT, "."), F.right(F.translate(parts[i - 1], DOT, "."), F.lit(reach))
            if source == "card":
                match = F.translate(match, JOIN, "-")
            right = F.left(F.translate(F.coalesce(F.get(parts, i + 1), F.lit("")), DOT, "."), F.lit(reach))
            fields = zip(FOUND, [*votes(kind, match, left, right), *features(match, left, right)], strict=True)
            before, after, far = neighbours(left, right)
            return F.struct(
                F.lit(KINDS.index(kind)).cast("byte").alias("kind"), F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("stop"),
                (passes(source, match) if source in BASE else F.lit(False)).alias("base"), *(v.cast("byte").alias(n) for n, v in fields), before.alias("cue_before"), after.alias("cue_after"), far.alias("cue_far"),
            )

        both = F.array(F.struct(parts.alias("parts"), ends.alias("ends")))
        found = F.flatten(F.transform(both, lambda b: F.transform(F.sequence(F.lit(1), F.size(b["parts"]) - 2, F.lit(2)), lambda i: one(b, i))))
        return F.filter(found, lambda x: x["base"]) if source in BASE else found

    none = F.array().cast(TYPE)
    marked = F.flatten(F.transform(F.array(parts), lambda p: F.when(F.size(p) > 2, from_parts(p)).otherwise(none)))
    return F.when(possible(source, text), marked).otherwise(none)


Pattern = tuple[tuple[int, ...], bool]
#: How a labeler is believed to vote on personal data; on the rest with the signs changed.
YES = {1: 0.4, 0: 0.5, -1: 0.1}
SURE = 0.65


def reliabilities(counts: dict[Pattern, float], rounds: int = 40, weight: float = 0.1) -> tuple[dict[Pattern, float], list[dict[int, tuple[float, float]]]]:
    """(the probability that candidates with each pattern of votes are personal data, each labeler's chances of a vote on such and on others).

    counts: how many candidates have each (votes, base). Expectation-maximisation over labelers that err independently; one
    that abstains says nothing.
    Matches of the base rules are known to be personal data. The prior belief, worth `weight` of all candidates, is that labelers are
    rather right than wrong and that most of what no rule matches is not personal, so the two classes can't change places.
    """
    belief = 1 + weight * sum(counts.values())
    labelers = len(next(iter(counts))[0])
    tables, prior = [{v: (YES[v], YES[-v]) for v in (-1, 0, 1)} for _ in range(labelers)], 0.1
    chance: dict[Pattern, float] = {}
    for step in range(rounds):
        if step:
            free = [(n, chance[p]) for p, n in counts.items() if not p[1]]
            prior = (sum(n * c for n, c in free) + 2 * belief) / (sum(n for n, _ in free) + 20 * belief)
            tables = []
            for k in range(labelers):
                yes, no = ({v: (YES[w * v]) * belief for v in (-1, 0, 1)} for w in (1, -1))
                for p, n in counts.items():
                    yes[p[0][k]] += n * chance[p]
                    no[p[0][k]] += n * (1 - chance[p])
                a, b = sum(yes.values()), sum(no.values())
                tables.append({v: (yes[v] / a, no[v] / b) for v in (-1, 0, 1)})
        odds = {p: math.log(prior / (1 - prior)) + sum(said(t, v) for t, v in zip(tables, p[0], strict=True) if v) for p in counts}
        chance = {p: 0.98 if p[1] else 1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for p, o in odds.items()}
    return chance, tables


def said(table: dict[int, tuple[float, float]], v: int) -> float:
    """What a vote adds to the log odds. Of those that speak, at least `SURE` are taken to be right in either class.

    Without that bound, candidates that all labelers see alike would make the classes the same.
    """
    yes, no = (max(table[w][c] / (table[1][c] + table[-1][c]), SURE) for w, c in ((1, 0), (-1, 1)))
    return math.log(yes / (1 - no)) if v > 0 else math.log((1 - yes) / no)


def columns_of(rows: np.ndarray) -> np.ndarray:
    """The one-hot columns of votes (-1 .. 1) and features, side by side, as their places."""
    sizes = np.array([3] * len(LABELERS) + list(FEATURES.values()))
    shift = np.array([1] * len(LABELERS) + [0] * len(FEATURES))
    return rows + shift + (np.cumsum(sizes) - sizes)


def classifier(rows: np.ndarray, chance: np.ndarray, rounds: int = 600, decay: float = 0.002) -> tuple[float, np.ndarray]:
    """(bias, weight of each one-hot column) of a logistic regression fitted to probabilities.

    A row has a column of each vote and feature, so the loss bends at most a quarter of their number; a longer step would swing.
    """
    rate = 4 / (rows.shape[1] + 1)
    width = 3 * len(LABELERS) + sum(FEATURES.values())
    weights, bias, at = np.zeros(width), 0.0, columns_of(rows)
    for _ in range(rounds):
        gap = 1 / (1 + np.exp(-np.clip(bias + weights[at].sum(axis=1), -30, 30))) - chance
        slope = np.bincount(at.ravel(), np.repeat(gap, at.shape[1]), width) / len(rows)
        weights -= rate * (slope + decay * weights)
        bias -= rate * gap.mean()
    return bias, weights


Cues = dict[int, tuple[str, str]]


def learned_cues(found: DataFrame) -> Cues:
    """Of each kind a mark for every bucket of words before a candidate, and after one: '+' for a cue, else '0'.

    Counts cover all candidates: how often a word is next to known examples of a kind, against how often it stands near
    candidates without being next to them. A word that is next to all candidates of the kind alike tells nothing.
    """
    known = F.col("base") | ((F.col("kind") >= len(BASE)) & (F.col("gazetteer") == 1))
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"cue_{name}").alias("bucket"))
    rows = found.select("kind", known.alias("known"), F.explode(F.array(*map(side, ("before", "after", "far")))).alias("s")).filter("s.bucket > 0")
    own, every = defaultdict(lambda: np.zeros(CUE_BUCKETS)), np.zeros(CUE_BUCKETS)
    for kind, is_known, side_of, bucket, n in rows.groupBy("kind", "known", "s.side", "s.bucket").count().collect():  # kinds x 2 x 3 x CUE_BUCKETS rows at most
        if side_of == "far":
            every[bucket] += n
        else:
            own[kind, side_of, is_known][bucket] += n

    def marks(kind: int, side: str) -> str:
        near, other = own[kind, side, True], own[kind, side, False]
        share = near / max(near.sum(), 1)
        cue = (near >= CUE_LEAST) & (share >= CUE_RATIO * (every + 1) / (every.sum() + 1)) & (share >= 1.5 * other / max(other.sum(), 1))
        return "".join("+" if c else "0" for c in cue)

    return {kind: (marks(kind, "before"), marks(kind, "after")) for kind in range(len(KINDS))}


def learned_vote(cues: Cues, kind: Column, before: Column, after: Column) -> Column:
    """1 where a learned cue stands next to the candidate, else 0."""
    out = F.lit(0)
    for number, (left, right) in cues.items():
        if "+" in left or "+" in right:
            marked = (F.substring(F.lit(left), before.cast("int") + 1, F.lit(1)) == "+") | (F.substring(F.lit(right), after.cast("int") + 1, F.lit(1)) == "+")
            out = F.when((kind == number) & marked, 1).otherwise(out)
    return out.cast("byte")


def fitted(found: DataFrame, sample: int) -> dict[int, tuple[float, np.ndarray]]:
    """The classifier of each kind, from rows of candidates; about `sample` of a kind are looked at one by one."""
    patterns: dict[int, dict[Pattern, float]] = defaultdict(dict)
    for row in sorted(found.groupBy("kind", "base", *LABELERS).count().collect()):
        patterns[row["kind"]][tuple(row[x] for x in LABELERS), row["base"]] = float(row["count"])
    if not patterns:
        return {}
    shares = F.create_map(*(F.lit(x) for kind, own in patterns.items() for x in (kind, min(1.0, sample / sum(own.values())))))
    drawn = F.pmod(F.xxhash64("start", "stop", "__id", *NAMES), F.lit(1 << 20)) < shares[F.col("kind").cast("int")] * (1 << 20)
    rows = found.filter(drawn).groupBy("kind", "base", *NAMES).count().collect()  # about sample rows of a kind at most
    out = {}
    for kind, own in patterns.items():
        chance, _ = reliabilities(own)
        mine = sorted(r for r in rows if r["kind"] == kind)
        if mine:
            each = np.array([[r[n] for n in NAMES] for r in mine]).repeat([r["count"] for r in mine], axis=0)
            given = np.array([chance[tuple(r[x] for x in LABELERS), r["base"]] for r in mine]).repeat([r["count"] for r in mine])
            out[kind] = classifier(each, given)
    return out


def pii_spans(docs: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = (), sample: int = 5000) -> DataFrame:
    """doc_id, the columns in keep, and spans array<struct<start, kind, stop, base>> by start, then kind."""
    text = text_of()
    found = F.concat(*(candidates(text, source) for source in SOURCES))
    docs = written(docs.select("doc_id", *keep, found.alias("__found")), "pii")
    each = docs.select(F.xxhash64("doc_id").alias("__id"), F.explode("__found").alias("c")).select("__id", "c.*")
    cues = learned_cues(each)
    models = fitted(each.withColumn("learned", learned_vote(cues, F.col("kind"), F.col("cue_before"), F.col("cue_after"))), sample)

    def accepted(c: Column) -> Column:
        ok = c["base"]
        for kind, (bias, weights) in models.items():
            score, at = F.lit(float(bias)), 0
            for name in NAMES:
                size = FEATURES.get(name, 3)
                value = learned_vote(cues, c["kind"], c["cue_before"], c["cue_after"]) if name == "learned" else c[name]
                place = value.cast("int") + (1 if name in FEATURES else 2)
                score = score + F.element_at(F.array(*(F.lit(float(w)) for w in weights[at : at + size])), place)
                at += size
            ok = ok | ((c["kind"] == kind) & (score > math.log(threshold / (1 - threshold))))
        return ok

    slim = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), c["base"].alias("base"))
    spans = F.array_sort(F.transform(F.filter("__found", accepted), slim)) if models else F.array().cast("array<struct<start:int,kind:tinyint,stop:int,base:boolean>>")
    return docs.select("doc_id", *keep, spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda c: F.array(*map(F.lit, KINDS))[c["kind"].cast("int")]
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", name(c), c["start"].cast("string"), c["stop"].cast("string"))), ",")


def pii_digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans as text, and how many there are."""
    of = lambda k: F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == k))).cast("long")
    base = F.filter("spans", lambda c: c["base"])
    return spans.select("doc_id", *(of(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>; of overlapping spans, the first."""
    name = lambda c: F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))[c["kind"].cast("int")]
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        more = F.array(F.substring(text, a["at"] + 1, c["start"] - a["at"]), name(c))
        return F.when(c["start"] < a["at"], a).otherwise(F.struct(c["stop"].alias("at"), F.concat(a["out"], more).alias("out")))

    done = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, done)).otherwise(text)
