"""Operator 8: the trees are fitted to every labelled url, by sums over tasks."""

import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import url_filter


def test_a_look_too_rare_for_a_sample_is_learned(spark):
    """36 of 60,000 labelled urls are blocked, and only they have long paths: a third of them were too few to part from the rest."""
    k = F.col("id")
    host = F.concat(F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "abcdefghij"), F.lit("."))
    allowed = spark.range(60_000).select(k.alias("page_id"), F.concat(F.lit("http://"), host, F.lit("com/y")).alias("url"))
    blocked = spark.range(100_000, 100_036).select(k, F.concat(F.lit("http://"), host, F.lit("net/x"), F.lit("y" * 40)))
    open_ones = spark.range(200_000, 200_100).select(k, F.concat(F.lit("http://"), host, F.lit("org/z"), F.lit("y" * 40)))
    rules = [("block", "net", "/x"), ("allow", "com", "/")]
    out = {r.page_id: r.verdict for r in url_filter.url_verdicts(allowed.union(blocked).union(open_ones), rules).filter("rule is null").collect()}
    assert len(out) == 100 and set(out.values()) == {"block"}


def test_tasks_sums_give_the_trees_of_the_rows_at_hand(spark, monkeypatch):
    draw = np.random.default_rng(7)
    rows = [(int(k), f"http://{''.join(draw.choice(list('abcdefgh'), int(draw.integers(3, 9))))}{k}.{s}/{'x' if s == 'net' else 'y'}{'z' * int(draw.integers(0, 6) + 3 * (s == 'net'))}") for k, s in enumerate(draw.choice(["net", "com"], 1500))]
    rules = [("block", "net", "/x"), ("allow", "com", "/y")]
    judged = url_filter.judged_urls(spark.createDataFrame(rows, "page_id long, url string"), rules)
    flat = lambda t: (t.value,) if t.feature < 0 else (t.feature, t.split, *flat(t.low), *flat(t.high))
    fits = []
    for rows_a_task in (200, 10_000):  # eight tasks, then one
        monkeypatch.setattr(url_filter, "ROWS_A_TASK", rows_a_task)
        model, scores = url_filter.fitted(judged, 0.3)
        fits.append(([flat(t) for t in model.trees], sorted(map(tuple, scores.collect()))))
    assert fits[0] == fits[1] and len(fits[0][1]) == 1500
    learn = url_filter.labelled(judged).collect()
    x, y = np.array([[r["__" + f] for f in url_filter.FEATURES] for r in learn]), np.array([float(r.y) for r in learn])
    bias, trees = url_filter.boosted(x, y)
    assert bias == 0.0 and [t.feature for t in trees[:2]] == [t[0] for t in fits[0][0][:2]]


def test_kth_is_exact(spark):
    draw = np.random.default_rng(3)
    values = [*draw.normal(size=3000).tolist(), *[0.25] * 500, 1e9, -1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [url_filter.kth(df, "v", k) for k in (0, 7, 1700, 2100, 3500, 3501)] == [sorted(values)[k] for k in (0, 7, 1700, 2100, 3500, 3501)]
