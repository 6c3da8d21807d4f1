"""Operator 8, URL filters: rules first, then gradient-boosted trees on lexical features.

Labelled URLs are those on which a rule decides. The trees are fitted to all distinct ones, where these lie: features become
bins at quantiles, tasks sum Newton's steps by leaf, feature and bin, and the driver sees only these sums, one job for each
level of a tree. Statistics of suffixes count every labelled row, but those of a host's own fold, so no row tells its own
label. The fitted trees become one SQL expression, so scoring stays in generated code.

Rules can cover a suffix one-sidedly; then its statistic only repeats which rules there are, and it counts as unknown. It
is also hidden from the fit in half of the rows, whose classes weigh alike as those of the others do. So one model judges
with the statistic and without it, and that it is unknown says nothing by itself.

What can't be told from looks is left alone: the score from which a url is blocked is chosen on hosts that the trees have
not seen, so that of the allowed ones among those at most a given share would be blocked.

Defined cases: a null url, or one without `://`, has an empty host and path; equal urls of a page's host are judged alike;
without labelled URLs every verdict of the trees is `allow`; rows are judged each, also where page_ids repeat or are null;
an empty table gives no rows; other columns are ignored. No column may be named with a leading `__`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.sources.shared import written

#: (verdict, host, path)
Rule = tuple[str, str, str]
FEATURES = ("url_length", "host_length", "path_length", "path_depth", "host_depth", "host_digits", "path_digits", "hyphens", "host_entropy", "path_entropy", "parameters", "suffix_rate")
#: The suffix_rate of what is unknown.
UNKNOWN = -1.0
FOLDS, SALTS = 5, 16
#: Bins of a feature; parts of a weight's unit, in which steps are summed; classes of one count in `kth`; labelled urls from which a further task pays.
BINS, UNIT, CLASSES, ROWS_A_TASK = 32, 1 << 20, 4096, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    url, pattern = F.coalesce(url, F.lit("")), "(?s)://([^/?#]*+)([^?#]*+)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else nulls."""
    found = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = found.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")))
    return found


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that one url gives; suffix_rate is joined on."""
    url = F.coalesce(url, F.lit(""))
    size = lambda c: F.length(c).cast("double")
    count = lambda text, of: (F.length(text) - F.length(F.replace(text, of))).cast("double")
    digits = lambda c: size(F.regexp_replace(c, "[^0-9]", "")) / F.greatest(size(c), F.lit(1.0))

    def entropy(text: Column) -> Column:
        share = lambda c: count(text, c) / F.greatest(size(text), F.lit(1.0))
        return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))))

    query = F.regexp_extract(url, r"(?s)\?([^#]*+)", 1)
    return {
        "url_length": size(url), "host_length": size(host), "path_length": size(path), "path_depth": count(path, F.lit("/")), "host_depth": count(host, F.lit(".")),
        "host_digits": digits(host), "path_digits": digits(path), "hyphens": count(url, F.lit("-")), "host_entropy": entropy(host), "path_entropy": entropy(path),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, F.lit("&")) + 1),
    }


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*+)$", 1)


class Tree:
    """A regression tree: feature < 0 marks a leaf, whose value is in `value`. place: the split as a bin; open: the number of a leaf that may still be split, else -1."""

    def __init__(self, feature: int = -1, split: float = 0.0, low: Tree | None = None, high: Tree | None = None, value: float = 0.0, place: int = 0, open: int = -1):
        self.feature, self.split, self.low, self.high, self.value, self.place, self.open = feature, split, low, high, value, place, open

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.split, self.low.predict(x), self.high.predict(x))

    def of_bins(self, bins: np.ndarray, what: str = "value") -> np.ndarray:
        """The leaves' values, or numbers (what is open), of rows given by bins."""
        if self.feature < 0:
            return np.full(len(bins), getattr(self, what))
        return np.where(bins[:, self.feature] <= self.place, self.low.of_bins(bins, what), self.high.of_bins(bins, what))

    def leaves(self) -> list[Tree]:
        return [self] if self.feature < 0 else self.low.leaves() + self.high.leaves()

    def column(self) -> Column:
        """The tree as an expression."""
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(F.col("__" + FEATURES[self.feature]) <= float(self.split), self.low.column()).otherwise(self.high.column())


class Model:
    """Trees of the log odds that y is 1, fitted without the rows of one fold (-1: to all).

    counts: rows by (hidden, y). Both classes weigh the same, among the rows whose suffix is hidden and among the others.
    """

    def __init__(self, left_out: int, counts: np.ndarray, rate: float):
        n, ones = counts.sum(axis=1), counts[:, 1]
        self.left_out, self.rate, self.trees, self.growing = left_out, rate, [], None
        self.weight = np.stack([n / (2 * np.maximum(n - ones, 1)), n / (2 * np.maximum(ones, 1))], axis=1)
        self.learns = bool(0 < ones.sum() < n.sum())
        self.bias = 0.0 if self.learns else 20.0 if ones.sum() else -20.0

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.of_bins(bins) * self.rate for t in self.trees), np.full(len(bins), self.bias))

    def split(self, sums: np.ndarray, cuts: list[np.ndarray], least: int, ridge: float) -> None:
        """Splits each open leaf where it gains most in slope^2 / (curve + ridge). sums: slope, curve and count by leaf, feature and bin."""
        made = 0
        for leaf in [t for t in self.growing.leaves() if t.open >= 0]:
            below = sums[leaf.open].cumsum(axis=1)
            (total_s, total_c, total_n), (s, c, n) = below[0, -1], np.moveaxis(below[:, :-1], 2, 0)
            leaf.value, leaf.open = total_s / (total_c + ridge), -1
            gain = s**2 / (c + ridge) + (total_s - s) ** 2 / (total_c - c + ridge) - total_s**2 / (total_c + ridge)
            gain[(n < least) | (total_n - n < least)] = -1
            f, k = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, k] > 1e-9:
                leaf.feature, leaf.place, leaf.split = int(f), int(k), float(cuts[f][k])
                leaf.low = Tree(value=s[f, k] / (c[f, k] + ridge), open=made)
                leaf.high = Tree(value=(total_s - s[f, k]) / (total_c - c[f, k] + ridge), open=made + 1)
                made += 2


def cuts_between(low: np.ndarray, high: np.ndarray, times: np.ndarray) -> np.ndarray:
    """At most BINS - 1 cuts at the quantiles of sorted classes of values (smallest, largest, count), each midway to the class above."""
    ends = np.cumsum(times)
    wanted = np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (ends[-1] - 1)) if len(ends) else np.zeros(0)
    at = np.unique(np.searchsorted(ends, wanted, side="right"))
    at = at[at < len(ends) - 1]  # nothing lies above the last
    return (high[at] + low[at + 1]) / 2


def tallied(bins: np.ndarray, y: np.ndarray, fold: np.ndarray, hidden: np.ndarray, models: list[Model]) -> np.ndarray:
    """Newton's slope and curve and the count of rows, by (model, open leaf, feature, bin), as whole numbers: sums don't depend on the order of rows."""
    leaves = max(t.open for m in models for t in m.growing.leaves()) + 1
    sums = np.zeros((len(models), leaves, bins.shape[1], BINS, 3), np.int64)
    for k, model in enumerate(models):
        at = np.flatnonzero(fold != model.left_out)
        leaf = model.growing.of_bins(bins[at], "open").astype(np.int64)
        at, leaf = at[leaf >= 0], leaf[leaf >= 0]
        chance, weight = 1 / (1 + np.exp(-model.scores(bins[at]))), model.weight[hidden[at].astype(int), y[at].astype(int)]
        steps = np.rint(weight * (y[at] - chance) * UNIT), np.rint(weight * chance * (1 - chance) * UNIT), None
        for f in range(bins.shape[1]):
            slot = leaf * BINS + bins[at, f]
            for j, step in enumerate(steps):
                sums[k, :, f, :, j] = np.bincount(slot, weights=step, minlength=leaves * BINS).reshape(leaves, BINS)
    return sums


def grow(models: list[Model], cuts: list[np.ndarray], tally: Callable[[list[Model]], np.ndarray], trees: int = 30, depth: int = 3, least: int = 20, ridge: float = 1.0) -> None:
    """Fits the models side by side: one tally (see `tallied`) a level of a tree, whatever the rows."""
    models = [m for m in models if m.learns]
    for _ in range(trees if models else 0):
        for m in models:
            m.growing = Tree(open=0)
        for _ in range(depth):
            live = [m for m in models if any(t.open >= 0 for t in m.growing.leaves())]
            if not live:
                break
            for m, sums in zip(live, tally(live) / np.array([UNIT, UNIT, 1.0]), strict=True):
                m.split(sums, cuts, least, ridge)
        for m in models:
            m.trees.append(m.growing)


def counted(y: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    return np.bincount(hidden.astype(int) * 2 + y.astype(int), minlength=4).reshape(2, 2)


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> tuple[float, list[Tree]]:
    """(bias, trees) of rows at hand, by the same steps as over a table."""
    seen = [np.unique(column, return_counts=True) for column in x.T]
    cuts = [cuts_between(v, v, n) for v, n in seen]
    bins = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T, strict=True)], axis=1)
    fold, hidden = np.zeros(len(y), int), np.zeros(len(y), bool)
    model = Model(-1, counted(y, hidden), rate)
    grow([model], cuts, lambda live: tallied(bins, y, fold, hidden, live), trees, depth)
    return model.bias, model.trees


def area(score: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs of a blocked and an allowed url that the score puts in order, ties by half."""
    _, place, times = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[place]
    n, m = y.sum(), len(y) - y.sum()
    return float((rank[y > 0].sum() - n * (n + 1) / 2) / (n * m)) if n and m else math.nan


def held_out_area(x: np.ndarray, y: np.ndarray, fold: np.ndarray, rate: float = 0.3) -> float:
    """The area of trees fitted without the hosts of fold 0, over those hosts' urls."""
    own = fold == 0
    bias, trees = boosted(x[~own], y[~own], rate=rate)
    return area(bias + rate * sum((t.predict(x[own]) for t in trees), np.zeros(own.sum())), y[own])


def kth(df: DataFrame, column: str, k: int) -> float:
    """The k-th smallest (from 0) of a column of doubles without nulls, exactly: counts by classes of equal width, again within the class that holds it."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        place = F.least(F.floor((F.col(column) - low) / (high - low) * CLASSES), F.lit(CLASSES - 1))
        inside = df.filter(F.col(column).between(low, high)).groupBy(place.alias("place"))
        for r in sorted(inside.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n")).collect(), key=lambda r: r["place"]):  # at most CLASSES rows
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def threshold(scores: DataFrame, wrong: float) -> float:
    """The log odds from which to block: at least even, and so high that on hosts not seen at most that share of the allowed urls would be. scores: score, y."""
    allowed = scores.filter("y = 0")
    n = allowed.count()
    return max(0.0, kth(allowed, "score", max(0, min(n - 1, math.ceil((1 - wrong) * n) - 1)))) if n else 0.0


def suffix_rates(labelled: DataFrame) -> DataFrame:
    """__suffix, __fold, __salt, __suffix_rate: how much of a suffix's labelled rows of other folds is blocked, classes weighed alike; null where all are of one class.

    A few rows for each suffix, however many rows it has; salts spread a common suffix over the tasks of the join.
    """
    counts = labelled.groupBy("__suffix", "__fold").agg(F.sum("__y").alias("b"), F.count("*").alias("n"))
    totals = counts.agg(F.sum("b").alias("b"), F.sum("n").alias("n")).first()
    b, n = totals["b"] or 0, totals["n"] or 0
    block_weight, allow_weight = n / (2 * max(b, 1)), n / (2 * max(n - b, 1))
    every = counts.groupBy("__suffix").agg(F.sum("b").alias("sb"), F.sum("n").alias("sn"))
    folds = every.select("__suffix", "sb", "sn", F.explode(F.array(*map(F.lit, range(FOLDS)))).alias("__fold"))
    other = folds.join(counts, ["__suffix", "__fold"], "left").select("__suffix", "__fold", (F.col("sb") - F.coalesce("b", F.lit(0))).alias("b"), (F.col("sn") - F.coalesce("n", F.lit(0))).alias("n"))
    blocked, allowed = F.col("b") * block_weight, (F.col("n") - F.col("b")) * allow_weight
    share = F.when((F.col("b") > 0) & (F.col("b") < F.col("n")), (blocked + 5) / (blocked + allowed + 10))
    return other.select("__suffix", "__fold", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"), share.alias("__suffix_rate"))


def judged_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, url, host, path, __fit (rule and verdict), the features and __fold of each row; __y and __hidden of those that a rule decides."""
    host, path = parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("__fit", fitting(F.col("host"), F.col("path"), rules))
    judged = judged.withColumns({"__" + k: v for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items()}).withColumn("__suffix", suffix(F.col("host")))
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    judged = judged.withColumn("__fold", fold).withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    judged = judged.withColumn("__y", (F.col("__fit.verdict") == "block").cast("long"))
    stats, key = written(suffix_rates(judged.filter("__fit is not null")), "suffixes"), ["__suffix", "__fold", "__salt"]
    return judged.join(stats, key, "left").withColumn("__suffix_rate", F.coalesce("__suffix_rate", F.lit(UNKNOWN)))


def labelled(judged: DataFrame) -> DataFrame:
    """The features, y, fold and hidden (whether the suffix's statistic is) of each distinct labelled url."""
    hidden = (F.pmod(F.xxhash64("host", F.lit("hidden")), F.lit(2)) == 0) | (F.col("__suffix_rate") == UNKNOWN)
    names = ["__" + f for f in FEATURES]
    learn = judged.filter("__fit is not null").select("url", *names, F.col("__y").alias("y"), F.col("__fold").alias("fold"), hidden.alias("hidden")).distinct()
    return learn.drop("url").withColumn("__suffix_rate", F.when(F.col("hidden"), UNKNOWN).otherwise(F.col("__suffix_rate")))


def cuts_of(learn: DataFrame) -> list[np.ndarray]:
    """Each feature's cuts, at quantiles of all rows. Values within a thousandth of an octave are one class, so few classes come to the driver."""
    values = learn.select(F.posexplode(F.array(*("__" + f for f in FEATURES))).alias("feature", "value"))
    classes = values.groupBy("feature", F.floor(F.log2(F.col("value") + 2) * 1024).alias("class")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    found = [[] for _ in FEATURES]
    for r in classes.collect():
        found[r["feature"]].append((r["low"], r["high"], r["n"]))
    return [cuts_between(*np.array(sorted(rows), float).reshape(-1, 3).T) for rows in found]


def fitted(judged: DataFrame, rate: float) -> tuple[Model, DataFrame]:
    """(the trees of all labelled urls, score and y of each by trees that haven't seen the hosts of its fold).

    The models of all folds and that of all rows grow together. Rows stay where they are, as bins; a level of the trees is one
    job, from which only sums by leaf, feature and bin come to the driver.
    """
    learn = written(labelled(judged), "labelled")
    counts = np.zeros((FOLDS, 2, 2), np.int64)
    for r in learn.groupBy("fold", "hidden", "y").count().collect():  # at most FOLDS * 4 rows
        counts[r["fold"], int(r["hidden"]), r["y"]] = r["count"]
    models = [Model(k, counts.sum(axis=0) - (counts[k] if k >= 0 else 0), rate) for k in range(-1, FOLDS)]
    cuts, names = cuts_of(learn), ["b" + f for f in FEATURES]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(np.searchsorted(c, batch.column("__" + f).to_numpy(zero_copy_only=False)).astype(np.int8)) for c, f in zip(cuts, FEATURES, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(n) for n in ("y", "fold", "hidden"))], names=[*names, "y", "fold", "hidden"])

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        bins = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).T  # by column, as they are asked for
        return bins, *(batch.column(n).to_numpy(zero_copy_only=False) for n in ("y", "fold", "hidden"))

    tasks = min(3 * judged.sparkSession.sparkContext.defaultParallelism, int(counts.sum()) // ROWS_A_TASK + 1)
    kinds = ", ".join(f"{n} tinyint" for n in names)
    rows = written(learn.repartition(tasks).mapInArrow(binned, kinds + ", y long, fold int, hidden boolean"), "binned")

    def tally(live: list[Model]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = 0
            for batch in batches:
                sums = sums + tallied(*rows_of(batch), live)
            if isinstance(sums, np.ndarray):
                flat = sums.reshape(-1, 3)
                slots = np.flatnonzero(flat[:, 2])
                yield pa.RecordBatch.from_arrays([pa.array(slots), *(pa.array(flat[slots, j]) for j in range(3))], names=["slot", "s", "c", "n"])

        found = rows.mapInArrow(run, "slot long, s long, c long, n long").groupBy("slot").agg(F.sum("s"), F.sum("c"), F.sum("n")).toArrow()
        leaves = max(t.open for m in live for t in m.growing.leaves()) + 1
        flat = np.zeros((len(live) * leaves * len(FEATURES) * BINS, 3))
        flat[found.column(0).to_numpy()] = np.stack([found.column(j).to_numpy() for j in (1, 2, 3)], axis=1)
        return flat.reshape(len(live), leaves, len(FEATURES), BINS, 3)

    grow(models, cuts, tally)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y, fold, _ = rows_of(batch)
            score = np.zeros(len(y))
            for model in models[1:]:
                own = fold == model.left_out
                score[own] = model.scores(bins[own])
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(y.astype(float))], names=["score", "y"])

    return models[0], written(rows.mapInArrow(unseen, "score double, y double"), "scores")


def url_verdicts(pages: DataFrame, rules: list[Rule], rate: float = 0.3, wrong: float = 0.02) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else the trees'), and block_score, the trees' probability.

    wrong: the share of allowed urls of hosts not seen that the trees may block; by that the score from which they block is chosen.
    """
    judged = judged_urls(pages, rules)
    model, scores = fitted(judged, rate)
    odds = sum((t.column() * rate for t in model.trees), F.lit(model.bias))
    least = threshold(scores, wrong)
    scored = judged.withColumn("__odds", odds).withColumn("block_score", 1 / (1 + F.exp(-F.col("__odds"))))
    verdict = F.coalesce("__fit.verdict", F.when(F.col("__odds") > least, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("__fit.rule").alias("rule"), verdict.alias("verdict"), "block_score")


def quality(pages: DataFrame, rules: list[Rule], wrong: float = 0.02) -> tuple[float, float, float]:
    """(area, share of blocked urls that are caught, share of allowed ones that are blocked) of labelled urls, each judged without the hosts of its fold."""
    _, scores = fitted(judged_urls(pages, rules), 0.3)
    blocked = F.avg((F.col("score") > threshold(scores, wrong)).cast("double"))
    share = {r["y"]: r["share"] for r in scores.groupBy("y").agg(blocked.alias("share")).collect()}
    area = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(scores) if len(share) == 2 else math.nan
    return area, share.get(1.0, math.nan), share.get(0.0, math.nan)
