"""Operator 7 on vectors of doubles: nearness and equality are those of the doubles, not of their float parts."""

import numpy as np

from tabulon.llm import ann


def test_doubles_that_floats_cannot_tell_apart(spark):
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(60, 12))
    rows = [(i, [float(v) for v in base[i % 60] + (i // 60) * 1e-11]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    got = {}
    for r in ann.nearest(frame, every=30, block_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(got) == 10
    for query, found in got.items():
        distance = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
        want = sorted((d, i) for i, d in enumerate(distance) if i != query)[:10]
        assert [i for i, _ in found] == [i for _, i in want] and [s for _, s in found] == [d for d, _ in want]
        assert 0 < found[0][1] < 1e-9  # as floats these would be equal
