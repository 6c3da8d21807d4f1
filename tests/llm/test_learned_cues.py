"""Operator 6: what it learns from the base rules' matches finds personal data whose cue words are in none of its lists."""

import numpy as np

from tabulon.llm import pii

PHONE, EMAIL = pii.KINDS.index("phone"), pii.KINDS.index("email")
#: Words of no language, so in no list.
INVENTED = ["zwonk", "brelf", "quastim", "flodder", "grimpul", "snarvel", "plonque", "tirbel"]


def texts(seed, cues=("zwonk", "brelf"), plain=400, taught=240):
    """(rows, plants, decoys): base phones behind the cues teach; local numbers behind the cues are plants, those behind other words decoys."""
    draw = np.random.default_rng(seed)
    word = lambda: "".join(draw.choice(list("abcdefghijklmnop"), int(draw.integers(3, 8))))
    words = [word() for _ in range(300)]
    some = lambda n: " ".join(draw.choice(words, n))
    local = lambda: f"1{draw.integers(10, 99)} {draw.integers(100, 999)} {draw.integers(1000, 9999)}"
    rows, plants, decoys = [], set(), set()
    for _ in range(taught):
        rows.append(f"{some(8)} {draw.choice(list(cues))} +{draw.integers(1, 99)} {draw.integers(100, 999)} {draw.integers(100, 999)} {draw.integers(1000, 9999)} {some(4)}")
    for k in range(plain):
        left = f"{some(8)} {draw.choice(list(cues)) if k % 2 else draw.choice(words)} "
        number = local()
        (plants if k % 2 else decoys).add((len(rows), len(left), PHONE, len(left) + len(number)))
        rows.append(f"{left}{number} {some(4)}")
    return list(enumerate(rows)), plants, decoys


def added(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, s.start, s.kind, s.stop) for r in pii.pii_spans(frame).collect() for s in r.spans if not s.base}


def test_cues_are_learned_from_base_matches(spark):
    for seed, cues in ((1, INVENTED[:2]), (2, INVENTED[2:6])):
        rows, plants, decoys = texts(seed, tuple(cues))
        got = added(spark, rows)
        assert len(got & plants) >= 0.9 * len(plants) and len(got & decoys) <= 0.1 * len(decoys)


def test_nothing_is_learned_where_base_matches_teach_nothing(spark):
    rows, plants, _ = texts(3, taught=0)
    assert len(added(spark, rows) & plants) <= 0.1 * len(plants)


def test_counts_choose_the_cues(spark):
    rows, _, _ = texts(4)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    each = frame.select(pii.F.explode(pii.F.concat(*(pii.candidates(pii.text_of(), s) for s in pii.SOURCES))).alias("c")).select("c.*")
    cues = pii.learned_cues(each)
    buckets = {w: frame.sparkSession.range(1).select(pii.neighbours(pii.F.lit(f"x {w} "), pii.F.lit(""))[0].alias("b")).first()["b"] for w in ("zwonk", "brelf", "never")}
    assert [cues[PHONE][0][buckets[w]] for w in buckets] == ["+", "+", "0"] and cues[PHONE][0].count("+") <= 6 and "+" not in cues[EMAIL][0]
