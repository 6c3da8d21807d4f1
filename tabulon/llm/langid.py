"""Operator 10, language ID: mixture inference over n-gram likelihoods.

Learning: counts of hashed byte trigrams of words for each language, over a sample of about
`learn_per_language` whole labelled documents a language, chosen by a hash. Each word of a text has a
likelihood under each language. A document is a mixture: expectation-maximisation estimates the
proportions of the languages; a further language enters the document's set only if its gain in
log-likelihood exceeds a penalty that grows with the logarithm of the document's words.

The prediction is the largest proportion in the selected set, and that proportion is its score.

Defined cases: a null text, or one without a letter, is `und` with score 0; without labelled documents all
are `und`; ties go to the language that sorts first; rows are judged each, also where doc_ids repeat; a very long text
is held alone; an empty table gives
no rows; rows with a null lang or doc_id teach nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import in_batches, mix64, slices, spread, words_of

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """scores[gram, language]: the log-probability of a hashed trigram."""

    languages: tuple[str, ...]
    scores: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams_of(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of the bytes of each word with a space around it, how many each word has); at least one."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(words), "", " ")
    sizes = np.asarray(pc.binary_length(padded), dtype=np.int64)
    data = np.frombuffer(b"".join(padded.to_pylist()) if pa.types.is_binary(padded.type) else "".join(padded.to_pylist()).encode(), np.uint8).astype(np.uint64)
    starts, counts = np.cumsum(sizes) - sizes, np.maximum(sizes - 2, 1)
    if not len(data):
        return np.zeros(0, np.int64), counts
    at = spread(starts, counts)
    three = data[at] | data[np.minimum(at + 1, len(data) - 1)] << np.uint64(8) | data[np.minimum(at + 2, len(data) - 1)] << np.uint64(16)
    return (mix64(three) % np.uint64(buckets)).astype(np.int64), counts


def lettered(words: pa.Array) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(words, r"\pL"), dtype=bool)


def learn(docs: DataFrame, learn_per_language: int = 2000, buckets: int = 1 << 15, smoothing: float = 0.5, slice_bytes: int = 1 << 20) -> LanguageModel:
    """From doc_id, text, lang of documents that are not held out."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return LanguageModel((), np.zeros((buckets, 0), np.float32))
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, learn_per_language / n)))))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)

    def count(batches):
        languages = sorted(sizes)
        place, totals = {x: i for i, x in enumerate(languages)}, np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            of = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, texts in slices(batch.column(1), slice_bytes):
                offsets, numbers, distinct = words_of(texts)
                grams, n = grams_of(distinct, buckets)
                starts, word_lang = np.cumsum(n) - n, np.repeat(of[first : first + len(texts)], np.diff(offsets))
                pairs, times = np.unique(numbers * len(languages) + word_lang, return_counts=True)
                word, lang = pairs // len(languages), pairs % len(languages)
                each = n[word]
                np.add.at(totals, (np.repeat(lang, each), grams[spread(starts[word], each)]), np.repeat(times, each))
        lang, gram = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(gram, pa.int32()), pa.array(totals[lang, gram])], names=["lang", "gram", "n"])

    sampled = known.filter(chance < share[F.col("lang")]).select("lang", "text")
    counts = np.zeros((buckets, len(sizes)), np.float64)
    for lang, gram, n in sampled.transform(in_batches(count, "lang int, gram int, n long")).groupBy("lang", "gram").agg(F.sum("n")).collect():  # buckets x languages at most
        counts[gram, lang] = n
    totals = counts.sum(axis=0)
    return LanguageModel(tuple(sorted(sizes)), np.log((counts + smoothing) / (totals + smoothing * buckets)).astype(np.float32))


def mixture(chances: np.ndarray, offsets: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of the allowed languages in each run of words, log-likelihood), by expectation-maximisation."""
    sizes = np.diff(offsets)
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(rounds):
        joint = chances * shares[owner].astype(np.float32)
        total = np.maximum(joint.sum(axis=1), 1e-30)
        shares = np.add.reduceat(joint / total[:, None], offsets[:-1], axis=0, dtype=np.float64) / sizes[:, None]
    joint = (chances * shares[owner].astype(np.float32)).sum(axis=1)
    return shares, np.add.reduceat(np.log(np.maximum(joint, 1e-30)), offsets[:-1], dtype=np.float64)


def languages_of(texts: pa.Array, model: LanguageModel, rounds: int = 8, penalty: float = 2.0, notice: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language, -1 for none; score; texts x languages: whether the text's set holds the language) of each text."""
    best, score, count = np.full(len(texts), -1), np.zeros(len(texts)), len(model.languages)
    inside = np.zeros((len(texts), count), bool)
    offsets, numbers, distinct = words_of(pc.fill_null(texts, ""))
    if not len(numbers) or not count:
        return best, score, inside
    letters = lettered(distinct)
    keep = letters[numbers]
    kept = np.concatenate(([0], np.cumsum(keep)))
    offsets, numbers = kept[offsets], numbers[keep]
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return best, score, inside
    offsets = np.append(offsets[full], offsets[-1])
    grams, n = grams_of(distinct, model.scores.shape[0])
    logs = np.add.reduceat(model.scores[grams], np.cumsum(n) - n, axis=0)
    logs -= logs.max(axis=1, keepdims=True)
    chances = np.exp(np.maximum(logs, -30))[numbers]
    shares, _ = mixture(chances, offsets, np.ones((len(full), count)), rounds)
    order = np.argsort(-shares, axis=1, kind="stable")
    single = np.add.reduceat(np.log(np.maximum(chances, 1e-13)), offsets[:-1], axis=0, dtype=np.float64)
    top = single.argmax(axis=1)
    best[full], score[full] = top, shares[np.arange(len(full)), top]
    inside[full, top] = True
    value, sizes = single.max(axis=1), np.diff(offsets)
    for k in range(2, count + 1):  # sets of the k largest proportions, where the k-th is worth a look
        look = np.flatnonzero(shares[np.arange(len(full)), order[:, k - 1]] >= notice)
        if not len(look):
            break
        allowed = np.zeros((len(look), count))
        np.put_along_axis(allowed, order[look, :k], 1.0, axis=1)
        part, log = mixture(chances[spread(offsets[look], sizes[look])], np.concatenate(([0], np.cumsum(sizes[look]))), allowed, rounds)
        log -= penalty * (k - 1) * np.log(sizes[look] + 1)
        better = log > value[look]
        at = look[better]
        value[at], best[full[at]], score[full[at]] = log[better], part[better].argmax(axis=1), part[better].max(axis=1)
        inside[full[at]] = allowed[better] > 0
    return best, np.clip(score, 0, 1), inside


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = (), slice_bytes: int = 1 << 20) -> DataFrame:
    """The columns in keep, then lang_pred, score and languages (the chosen set, in order of name) of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats
    sent = [*keep] if "text" in keep else [*keep, "text"]

    def predict(batches):
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            found, scores, sets = [], [], []
            for _, texts in slices(batch.column(sent.index("text")), slice_bytes):
                best, score, inside = languages_of(texts, model)
                found.append(names[best])
                scores.append(score)
                sets += [names[:-1][own].tolist() for own in inside]
            columns = [*batch.columns[: len(keep)], pa.array(np.concatenate(found or [[]]), pa.string()), pa.array(np.concatenate(scores or [[]]), pa.float64()), pa.array(sets, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "languages"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, languages array<string>"])
    return docs.select(*sent).transform(in_batches(predict, schema))


def language_id(docs: DataFrame, learn_per_language: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages."""
    return identify(docs, learn(docs, learn_per_language), ("doc_id",)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
