"""Operator 2 below crowded nodes: whole results, and work that grows with the number of close copies."""

import random

import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import minhash_forest


def copies(draw, count, words=40, changed=1, vocabulary=5000):
    base = [f"w{draw.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(changed):
            text[draw.randrange(words)] = f"v{draw.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def plain_groups(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            k = len(sets[i] & sets[j])
            if k >= threshold * (len(sets[i]) + len(sets[j]) - k) - 1e-6:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(find(i), links[i]) for i in range(len(texts))]


def test_crowded_nodes_lose_no_link(spark, monkeypatch):
    draw = random.Random(3)
    texts = copies(draw, 150, 80) + copies(draw, 120, 80, 2) + copies(draw, 40, 60) + [" ".join(f"w{draw.randrange(50)}" for _ in range(60)) for _ in range(60)]
    draw.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_groups(texts)
    for packet in (16, 64, 512):
        monkeypatch.setattr(minhash_forest, "PACKET", packet)
        got = {r.doc_id: (r.group_id, r.n_links) for r in minhash_forest.jaccard_join(frame).collect()}
        assert [got[i] for i in range(len(texts))] == want


def compared(spark, count, monkeypatch):
    """(rows that meet below crowded nodes, edges between neighbours) of `count` close copies that share the floor of every tree."""
    trees, depth, floor = 16, 8, 4
    rnd = np.random.default_rng(1)
    values = np.tile(rnd.integers(0, 1 << 16, trees * depth).astype(np.uint16), (count, 1))
    tree, place = np.arange(count) % trees, 4 + rnd.integers(0, 4, count)  # one value below some floor differs
    values[np.arange(count), tree * depth + place] = rnd.integers(0, 1 << 16, count)
    able = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(values)], "class_id long, signature binary").repartition(8)
    met, near = [], []
    across, neighbours = minhash_forest.across, minhash_forest.neighbours
    monkeypatch.setattr(minhash_forest, "across", lambda rows, size: met.append(out := across(rows, size)) or out)
    monkeypatch.setattr(minhash_forest, "neighbours", lambda *a: near.append(out := neighbours(*a)) or out)
    found = minhash_forest.candidate_groups(able, trees, depth, floor, 0.8, 0.9995, 84, 512)
    assert found.count() == count - 1 and found.agg(F.max("root")).first()[0] == 0  # one set
    return sum(m.count() for m in met), sum(n.count() for n in near)


def test_work_among_close_copies_is_linear(spark, monkeypatch):
    rows = {}
    for count in (2000, 8000):
        with monkeypatch.context() as m:
            rows[count] = compared(spark, count, m)
    assert rows[8000][0] <= 6 * max(rows[2000][0], 2000) and rows[8000][1] <= 1.01 * 16 * 8000


def test_all_pairs_meet_but_those_of_the_largest_set(spark):
    rows = [(0, 7, i, 0 if i < 60 else i) for i in range(75)] + [(0, 8, i, 1) for i in range(30)]
    dealt = minhash_forest.across(spark.createDataFrame(rows, "tree int, node long, class_id long, root long"), 8).collect()
    blocks = {}
    for r in dealt:
        blocks.setdefault((r.tree, r.node, r.i, r.j), []).append(r)
    pairs = {tuple(sorted((a.class_id, b.class_id))) for group in blocks.values() for a in group if a.left for b in group if b.right and a.class_id != b.class_id}
    assert pairs >= {(a, b) for a in range(75) for b in range(a + 1, 75) if b >= 60} and {r.node for r in dealt} == {7}
    assert len(dealt) <= 60 * 2 + 15 * (2 + 8)
