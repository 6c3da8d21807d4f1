"""Operators 11 to 13 against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tabulon.llm import centroids, lm_scoring, periodic_runs

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, row long, n long, token string"


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "clash", 1, 2, "clash") for i, t in texts], DOCS)


def odd_texts():
    rnd = random.Random(5)
    line = "one two three four five six seven "
    out = [None, "", " \n\t ", "a", "A a A a A a A a A a A a A a", line * 9, "x " * 3000, "é ü é ü " * 5 + "日本 " * 14, "\x0b".join("abcab" * 4), "word one word one " * 8]
    out += [" ".join(rnd.choice("ab" if k % 2 else "abc") for _ in range(rnd.randrange(1, 90))) for k in range(160)]
    out += [" ".join(f"w{rnd.randrange(2000)}" for _ in range(rnd.randrange(400))) for _ in range(40)] + [line, line]
    return [(i, t) for i, t in enumerate(out)] + [(None, "no id"), (3, "twice the id")]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_texts())


# ---------------------------------------------------------------- periodic runs


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + p] for i in range(len(words) - p)]
        at = 0
        for equal, group in itertools.groupby(same):
            size = len(list(group))
            if equal and size + p >= max(least, 2 * p):
                found.setdefault((at, size + p), p)
            at += size
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_digest(doc_id, text):
    words, h = re.findall(WORD, text or ""), 1 if doc_id is None else crc(doc_id)
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), s, length, q, None if q is None else 1000 * length // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_and_collapsed_texts(odd):
    got = [tuple(r) for r in periodic_runs.run_digest(odd).select(*RUN_COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted((plain_digest(i, t) for i, t in odd_texts()), key=repr)
    assert sum(r[1] > 0 for r in got) > 40


def test_runs_of_other_lengths_and_columns(spark):
    df = spark.createDataFrame([("k", "a b a b a c c c c", 7), ("m", None, 8)], "key string, body string, runs int")
    rows = {r["key"]: r for r in periodic_runs.periodic_runs(df, "body", ("key",), least=4).collect()}
    assert [tuple(x) for x in rows["k"]["runs"]] == [(0, 5, 2), (5, 4, 1)] and rows["k"]["collapsed"] == "a b c" and rows["m"]["n_words"] == 0 and rows["m"]["collapsed"] == ""


def test_shared_lengths_against_comparison():
    rnd = np.random.default_rng(3)
    for size, letters in ((40, 2), (300, 3), (200, 1), (2, 1)):
        symbols = np.append(rnd.integers(1, letters + 1, size), 0)
        lengths = periodic_runs.SharedLengths(symbols)
        a, b = np.array([(i, j) for i in range(size) for j in range(i + 1, size)][::7]).T if size > 2 else (np.array([0]), np.array([1]))
        plain = [next(k for k in range(size + 1) if j + k >= len(symbols) or symbols[i + k] != symbols[j + k]) for i, j in zip(a, b, strict=True)]
        assert lengths.of(a, b).tolist() == plain


def test_runs_of_no_rows(spark):
    assert periodic_runs.run_digest(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- centroid clustering


def plain_clusters(vectors, k=8, rounds=10):
    xs = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(xs, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [list(v) for _, v in drawn]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in xs]
        for n in range(len(cs)):
            mine = [v for (_, v), o in zip(xs, own, strict=True) if o == n]
            if mine:
                cs[n] = [sum(d) // len(mine) for d in zip(*mine, strict=True)]
    final = [(i, *near(v)) for i, v in xs]
    inertia = collections.Counter()
    for _, d, n in final:
        inertia[n] += d
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, d, n in final]


CLUSTER_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustered(df):
    return sorted((tuple(r) for r in centroids.cluster_digest(centroids.centroid_clusters(df)).select(*CLUSTER_COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_against_plain_rounds(spark, kind):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(i % 5, 1, 64)], 0) for i in range(150)]
    rows += [(200 + i, [float(i % 2)] * 64, 0) for i in range(20)]  # ties and repeated vectors
    rows += [(7, [0.25] * 64, 0), (300, None, 0), (301, [1.0] * 63, 0), (302, [None] + [1.0] * 63, 0), (303, [math.nan] + [1.0] * 63, 0), (304, [math.inf] + [0.0] * 63, 0), (305, [], 0)]
    rows += [(400, [1e6] * 64, 0), (401, [-3e5] * 64, 0)]  # beyond what squares in 64 bits allow
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster int")
    assert clustered(df) == sorted(plain_clusters([(i, v) for i, v, _ in rows]), key=repr)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert clustered(spark.createDataFrame(rows, schema)) == sorted(plain_clusters(rows), key=repr)
    assert clustered(spark.createDataFrame([(1, None)], schema)) == []
    far = clustered(spark.createDataFrame([(None, [1.0] * 64), (1, [2.0] * 64)], schema))
    assert [r[:3] for r in far] == [(1, 0, 0), (None, 1, 0)]


def test_partial_distances_abandon_none_that_tie():
    rnd = np.random.default_rng(2)
    x, c = rnd.integers(-3, 4, (500, 16)), rnd.integers(-3, 4, (6, 16))
    c[4] = c[1]
    full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for order in (np.arange(16), rnd.permutation(16)):
        cluster, distance = centroids.nearest(x, c, order, step=3)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_a_distance_beyond_a_long_is_null(spark):
    rows = [(i, [0.0] * 64) for i in range(8)] + [(8, [8e15] * 64)]
    got = centroids.cluster_digest(centroids.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=1, rounds=0)).collect()
    assert {r["inertia"] for r in got} == {None} and sum(r["distance"] is None for r in got) in (1, 8)


# ---------------------------------------------------------------- language-model scores


def tokens(text):
    return [*re.findall(WORD, (text or "").translate(LOWER)), ""]


def typical(count):
    return 0.75 * 2 ** int(count).bit_length() - 0.5 if count else 0.0


def plain_scores(texts, weight):
    taught = [tokens(t) for i, t in texts if i is None or crc(i) % 7 != 2]
    single = collections.Counter(w for t in taught for w in t)
    double = collections.Counter(p for t in taught for p in zip([None, *t], t, strict=False))
    n, v = single.total(), len(single)
    for i, t in texts:
        own, base, score, before = tokens(t), 0.0, 0.0, None
        for w in own:
            base += math.log10((single[w] + 1) / (n + v + 1))
            context = typical(len(taught) if before is None else single[before])
            p = (typical(single[w]) + 1) / (n + v + 1)
            score += math.log10((min(typical(double[before, w]), context, typical(single[w])) + weight * p) / (context + weight))
            before = w
        yield i, i is not None and crc(i) % 7 == 2, len(own), sum(w in single for w in own), n, base, score


def test_scores_against_plain_counts(odd):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm_scoring.lm_scores(odd).collect()), key=repr)
    plain = sorted(plain_scores(odd_texts(), 32.0), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in plain]
    for mine, other in zip(got, plain, strict=True):
        assert mine[5] == pytest.approx(other[5], abs=1e-9) and abs(mine[6] - other[6]) / mine[2] < 0.9  # a false positive raises one count
    assert abs(sum(a[6] - b[6] for a, b in zip(got, plain, strict=True))) / sum(a[2] for a in got) < 0.02


def test_without_false_positives_scores_are_exact(spark, odd):
    texts = odd.select("doc_id", "text", "token")
    model = lm_scoring.learn(texts.filter(~lm_scoring.held_out(texts["doc_id"])), bits_each=400, probes=8, slots=16)
    got = lm_scoring.scored(texts, model, ("doc_id", "token")).collect()
    plain = sorted((r[0] or -1, round(r[6], 6)) for r in plain_scores(odd_texts(), 32.0))
    assert sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in got) == plain and {r["token"] for r in got} == {"clash"}


def test_slabs_and_rare_tokens_change_nothing(odd):
    taught = odd.filter(~lm_scoring.held_out(odd["doc_id"]))
    for order in (1, 3):
        one, many = lm_scoring.learn(taught, order), lm_scoring.learn(taught, order, slab_bytes=2000, common=3, max_token=4, hold=100)
        assert len(one.slabs) == 1 and len(many.slabs) >= (2 if order == 1 else 3) and len(many.common) <= 3
        a, b = (sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in lm_scoring.scored(odd, m).collect()), key=repr) for m in (one, many))
        assert a == b


def test_quantised_counts_are_at_least_the_true_ones(spark):
    df = spark.createDataFrame([(i, " ".join(["often"] * 40 + [f"once{i}"])) for i in range(30)], "doc_id long, text string")
    model = lm_scoring.learn(df)
    bits = np.zeros(int(model.starts[-1]) // 8, np.uint8)
    for slot, part in model.filter.select("slot", "bits").collect():
        at = int(model.starts[slot]) // 8
        bits[at : at + len(part)] = np.frombuffer(part, np.uint8)
    import pyarrow as pa

    own = lm_scoring.hashes_of(*lm_scoring.tokens_of(pa.array(["often once3 never"])), 1)[0]
    q = lm_scoring.quantised(own, bits, model.starts, (0, 4096), 12, model.probes)
    assert q[0] >= 11 and q[1] >= 1 and q[3] >= 5  # 1200, 1 and 30 times
    assert model.tokens == 30 * 42 and model.kinds == 32 and model.texts == 30


def test_nothing_to_learn_and_no_rows(spark):
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    row = lm_scoring.lm_scores(documents(spark, [(held, "a b")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)
    assert lm_scoring.lm_scores(documents(spark, [])).count() == 0
