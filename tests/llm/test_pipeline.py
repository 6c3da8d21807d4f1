"""The pipeline on small documents: what each stage decides takes effect."""

import zlib

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    words = [f"word{k}" for k in range(90)]
    body, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, body), (2, body + " more"), (3, None), (4, "123 456"), (5, other + " write to me@here.org now"), (6, "A " + " ".join(words[20:80]) + " B"), (7, " ".join(f"unlike{k}" for k in range(50)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert set(corpus_pipeline.COLUMNS) <= set(docs.columns)
    assert set(out["language_id"]) == {1, 2, 5, 6, 7}
    assert set(out["near_duplicates"]) == {1, 5, 6, 7}
    assert out["repeated_passages"][7].text == rows[6][1] and len(out["repeated_passages"][6].text) < 60
    assert "me@here.org" not in out["pii"][5].text and "<EMAIL>" in out["pii"][5].text
    assert set(out["packing"]) == {1, 5, 6, 7}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out["packing"])


def test_each_row_is_a_document(spark, tmp_path):
    texts = {name: " ".join(f"{name}{k}" for k in range(90)) for name in ("alpha", "beta", "gamma", "delta")}
    rows = [(1, texts["alpha"]), (1, texts["alpha"]), (1, texts["beta"]), (2, texts["alpha"] + " more"), (None, texts["gamma"]), (None, texts["delta"]), (None, texts["beta"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([("1", texts["alpha"]), ("1", texts["beta"]), ("None", texts["gamma"]), ("None", texts["delta"])])
    for name in ("near_duplicates", "repeated_passages"):
        docs = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == want
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(tmp_path)).collect()
    assert len(packed) == 4 and len({(r.sequence_id, r.offset) for r in packed}) == 4


def test_no_language_to_learn(spark, tmp_path):
    rows = [(1, "some words", None), (2, None, None), (3, "123 456", None), (4, "日本語", None), (5, "", None)]
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], schema)
    assert {(r.doc_id, r.text, r.lang) for r in stage(spark, docs, str(tmp_path)).collect()} == {rows[0], rows[3]}
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    docs = spark.createDataFrame([(held, "some words", "en", "s", 10)], schema)  # the only labelled row is held out
    assert [(r.doc_id, r.lang) for r in stage(spark, docs, str(tmp_path)).collect()] == [(held, "en")]


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, spans string, class_id long, kind int, lang_pred string"
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(1, words, None, None, None), (2, words + " end", "en", "s", 1), (3, "other text here, mail a@b.org", "en", "s", 2)]
    for own in ([], rows):
        folder = f"{tmp_path}/{len(own)}"
        docs = spark.createDataFrame([(*r, "x", "y", 5, 6, "z") for r in own], schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:  # each stage on the columns as they came
            out = stage(spark, docs, folder)
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            assert out.count() == (2 if own and name == "near_duplicates" else len(own)), name
        packed = corpus_pipeline.run(spark, folder)
        assert sorted(r.doc_id for r in packed.collect()) == ([1, 3] if own else [])


def test_against_a_plain_pipeline(spark, tmp_path):
    """Near duplicates and repeated passages by brute force over rows, with repeated and missing doc_ids."""
    import numpy as np

    draw = np.random.default_rng(12)
    passage = " ".join(f"shared{k}" for k in range(40))
    texts = []
    for k in range(40):
        own = [f"doc{k}w{j}" for j in range(int(draw.integers(20, 60)))]
        texts.append(" ".join(own))
        if k % 4 == 0:
            texts.append(" ".join(own + ["more"]))
        if k % 5 == 0:
            texts.append(" ".join(own[:10]) + " " + passage + " " + " ".join(own[::-1]))
    ids = [None if k % 17 == 3 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (t.split() for t in texts)]
    order = sorted(range(len(texts)), key=lambda k: (ids[k] is None, ids[k] or 0))
    root = list(range(len(texts)))
    for a in order:
        for b in order:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]), key=order.index)
                root = [low if r == high else r for r in root]
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path))
    left.write.parquet(f"{tmp_path}/left")
    left = spark.read.parquet(f"{tmp_path}/left")
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(k)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in left.collect())
    assert len(got) == len(groups) < len(texts)
    for own in groups.values():  # of each group one row whose doc_id is the smallest
        least = min((ids[k] if ids[k] is not None else 10**9) for k in own)
        assert sum((i if i >= 0 else 10**9, t) in {(ids[k] if ids[k] is not None else 10**9, texts[k]) for k in own} for i, t in got) == 1
        assert any((least if least < 10**9 else -1, texts[k]) in got for k in own)
    kept = [t for _, t in got]
    seen = {}
    for t in kept:
        for j in range(len(t) - 199):
            seen[t[j : j + 200]] = seen.get(t[j : j + 200], 0) + 1
    want = []
    for t in kept:
        gone = bytearray(len(t))
        for j in range(len(t) - 199):
            if seen[t[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        want.append("".join(c for c, g in zip(t, gone, strict=True) if not g))
    out = dict(corpus_pipeline.STAGES)["repeated_passages"](spark, left, str(tmp_path))
    assert sorted(r.text for r in out.collect()) == sorted(want) and sum(map(len, want)) < sum(map(len, kept))
