"""The queries op1_ ... op13_, each with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import ann, centroids, langid, lm_scoring, minhash_forest, packing, periodic_runs, pii, segmentation, simhash, suffix_dedup, url_filter, warc
from tabulon.llm.common import table

#: verdict, host, path
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.jaccard_join(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.nbest_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.pii_spans(table(spark, sf_dir, "documents")))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digest(centroids.centroid_clusters(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_best_fit_packing, op2_ngram_jaccard_join, op3_sentencepiece, op4_suffix_array_dedup, op5_warc,
        op6_pii, op7_nearest_neighbours, op8_url_filter, op9_simhash, op10_language_id, op11_lm_scoring, op12_periodic_runs, op13_centroid_clustering, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return ORACLE | {"op13_centroid_clustering": clustering_sql()}


def clustering_sql(rounds: int = 10) -> str:
    """The rounds of operator 13, one after another."""
    near = """(SELECT id, arg_min(k, {{'d': d, 'k': k}}) AS k, min(d) AS d FROM (SELECT v.id, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d
    FROM v CROSS JOIN c{} c) GROUP BY id)"""
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x FROM v ORDER BY sha256('3:' || vec_id), x LIMIT 8)"]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED {near.format(r)}")
        parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS x
    FROM (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT k, x, unnest(range(1, 65)) AS i FROM a{r} JOIN v USING (id)) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return f"""WITH {", ".join(parts)}, a AS MATERIALIZED {near.format(rounds)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN v USING (id) JOIN c{rounds} c USING (k)"""


#: Where SQL can express the whole result. The others are held against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, min(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM d),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingles,
        CASE WHEN len(words) = 0 THEN doc_id END AS alone FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS class_id, count(*) AS size, len(shingles) AS n, shingles, alone FROM s GROUP BY shingles, alone),
e AS MATERIALIZED (SELECT class_id, unnest(shingles) AS shingle FROM c WHERE alone IS NULL),
common AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k FROM e a JOIN e b ON a.shingle = b.shingle AND a.class_id <> b.class_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b, y.size FROM common JOIN c x ON x.class_id = a JOIN c y ON y.class_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-6),
reach AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
g AS (SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY a),
l AS (SELECT a AS class_id, sum(size) AS links FROM links GROUP BY a)
SELECT s.doc_id, c.class_id, g.group_id, CAST(coalesce(l.links, 0) + c.size - 1 AS BIGINT) AS n_links
FROM s JOIN c ON c.shingles = s.shingles AND c.alone IS NOT DISTINCT FROM s.alone JOIN g ON g.class_id = c.class_id LEFT JOIN l ON l.class_id = c.class_id
""",
    "op4_suffix_array_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, encode(min(coalesce(text, ''))) AS data FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS MATERIALIZED (SELECT doc_id, pos, md5_number(data[pos:pos + 199]) AS h FROM (SELECT doc_id, data, unnest(range(1, octet_length(data) - 198)) AS pos FROM d)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, pos, pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200 AS later FROM w SEMI JOIN r USING (h)),
runs AS (SELECT doc_id, min(pos) AS low, max(pos) + 200 AS high FROM (SELECT doc_id, pos, count_if(coalesce(later, false)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m) GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 1) AS begin_at, low AS end_at, high - low AS removed FROM (SELECT * FROM runs UNION ALL SELECT doc_id, octet_length(data) + 1, NULL FROM d))
SELECT d.doc_id, octet_length(any_value(data)) AS n_bytes, CAST(coalesce(sum(removed), 0) AS BIGINT) AS n_removed, count(removed) AS n_spans,
       sha256(unhex(string_agg(hex(data[begin_at:end_at - 1]), '' ORDER BY begin_at))) AS kept_sha256
FROM d JOIN k USING (doc_id) GROUP BY d.doc_id
""",
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100
""",
    "op12_periodic_runs": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) AS h FROM documents),
s AS (SELECT *, len(words) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM d),
e AS MATERIALIZED (SELECT id, doc_id, n, CASE WHEN a IS NULL THEN words
        ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS words FROM s),
six AS MATERIALIZED (SELECT id, i, md5_number(array_to_string(words[i + 1:i + 6], ' ')) AS six FROM (SELECT id, words, unnest(range(0, n - 5)) AS i FROM e)),
pairs AS (SELECT x.id, y.i - x.i AS p, x.i FROM six x JOIN six y ON x.id = y.id AND x.six = y.six AND x.i < y.i),
islands AS (SELECT id, p, min(i) AS start, count(*) + 5 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY id, p ORDER BY i) AS island FROM pairs) GROUP BY id, p, island),
runs AS MATERIALIZED (SELECT id, start, length, min(p) AS period FROM islands WHERE length >= 2 * p AND length >= 12 GROUP BY id, start, length),
r AS (SELECT id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
        arg_min({'start': start, 'length': length, 'period': period}, {'a': -length, 'b': start, 'c': period}) AS longest FROM runs GROUP BY id),
gone AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM (SELECT id, unnest(words) AS word, unnest(range(0, n)) AS i FROM e) w ANTI JOIN gone USING (id, i) GROUP BY w.id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(longest.start AS BIGINT) AS start, CAST(longest.length AS BIGINT) AS length, CAST(longest.period AS BIGINT) AS period,
       CAST(1000 * longest.length // longest.period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM e LEFT JOIN r USING (id) LEFT JOIN kept USING (id)
""",
}
