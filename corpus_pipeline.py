"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return COLUMNS. Each row is a
document of its own, also where rows repeat a doc_id or have none; doc_id stays as it is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import langid, minhash_forest, packing, pii, suffix_dedup
from tabulon.llm.common import keyed, table, text_of
from tabulon.sources.shared import new_folder, removed, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language. lang becomes the prediction, or stays where no language could be learned.

    Null texts, empty ones and those without a letter go; without documents none are learned from and none are left;
    rows are judged each; other columns than COLUMNS, whatever their names, are left out.
    """
    model = langid.learn(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.identify(docs.select(*COLUMNS), model, COLUMNS).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id (of equal or missing ids, that whose row comes first).

    Texts without words, null ones among them, are no duplicates of each other and stay; no documents give none; other
    columns than COLUMNS are left out.
    """
    docs, _ = keyed(docs)
    judged = minhash_forest.linked_rows(docs.select("row_key", text_of().alias("text")))
    return docs.join(judged.filter("row_key = group_id").select("row_key"), "row_key", "left_semi").select(*COLUMNS)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes what repeats across or within documents.

    Each row stays, if only with an empty text; null texts become empty; n_chars is counted anew; no documents give none;
    other columns than COLUMNS are left out.
    """
    kept = suffix_dedup.kept_texts(suffix_dedup.repeated_spans(docs, keep=("lang", "source")), ("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets.

    Each row stays; null and empty texts are empty; n_chars is counted anew; without documents nothing is learned and none
    are given; other columns than COLUMNS are left out.
    """
    found = pii.pii_spans(docs, keep=("text", "lang", "source"))
    clean = found.withColumn("text", pii.masked(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs; one row for each piece.

    Null and empty texts are their end token alone; rows with one doc_id, or none, are packed each by itself; very long texts
    are cut; no documents give no rows; other columns are left out.
    """
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express none of the stages' trained or iterative parts; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            removed(spark, before)
        before = path
    return docs
