"""The first pairs against the full list, and what it costs where one key holds half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import neardup, pair_report
from tabulon.plans import analysis


def sheet(spark, columns, rows):
    return spark.createDataFrame([(k + 2, *r) for k, r in enumerate(rows)], ", ".join(["__row long", *(f"`{c}` string" for c in columns)]))


WORDS = ["Acme", "Acne", "ACME", "Bolt", "Steel Works", "steel works", "Works Steel", "Ltd", "Trader", "Traders", "Iron Yard Delta", "Delta Iron Yard"]


def as_rows(df):
    return [tuple(r) for r in df.orderBy("a_row", "b_row").collect()]


@pytest.mark.parametrize("seed, hot", [(1, 0.0), (2, 0.5), (3, 0.9), (4, 0.0)])
@pytest.mark.parametrize("cap", [1, 7, 25])
def test_first_pairs_are_those_of_the_full_list(spark, seed, hot, cap):
    draw = random.Random(seed)
    rows = []
    for k in range(150):
        name = draw.choice(["Acme Ltd", "acme", "ACME ltd", "Acme"]) if draw.random() < hot else " ".join(draw.sample(WORDS, draw.randint(1, 2)))
        rows.append((name if k % 17 else "", draw.choice("abcdefgh") if seed != 4 else str(k), "x"))
    frame = sheet(spark, ["Name", "Email", "Note"], rows)
    want = as_rows(neardup.near_duplicate_pairs(frame, "Name", ["Email", "Note"] if seed == 3 else ["Email"]))[:cap]
    got = as_rows(pair_report.first_pairs(frame, "Name", ["Email", "Note"] if seed == 3 else ["Email"], cap=cap))
    assert [r[:6] for r in got] == [r[:6] for r in want] and [sorted(r[6]) for r in got] == [sorted(r[6]) for r in want] and [r[7] for r in got] == [r[7] for r in want]


def test_one_kind_far_ahead_of_another(spark):
    rows = [("Acme",)] * 80 + [("acme ltd",)] + [("Acme",)] * 80 + [("Acme Inc",), ("acne",)]
    frame = sheet(spark, ["Name"], rows)
    assert as_rows(pair_report.first_pairs(frame, "Name", [])) == as_rows(neardup.near_duplicate_pairs(frame, "Name", []))[:25]


def test_no_pairs_and_no_rows(spark):
    frame = sheet(spark, ["Name"], [("one",), ("", ), ("something else",)])
    assert pair_report.first_pairs(frame, "Name", []).count() == 0
    assert pair_report.first_pairs(frame.limit(0), "Name", []).count() == 0


def test_half_of_all_rows_in_one_class(spark):
    n = 40_000
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Acme"), F.repeat(F.lit("."), (F.col("id") % 1000).cast("int")))).otherwise(F.sha2(F.col("id").cast("string"), 256))
    frame = spark.range(n).select((F.col("id") + 2).alias("__row"), name.alias("Name"))
    got = as_rows(pair_report.first_pairs(frame, "Name", []))
    assert [(r[0], r[2]) for r in got] == [(2, 2 + 2 * k) for k in range(1, 26)]
    assert neardup.pair_count(frame, "Name", []).first().n == (20_000**2 - 500 * 40**2) // 2  # what isn't listed


def test_details_of_an_analysis(spark):
    rows = [("Acme", "a"), ("acme ", "b"), ("Acme Ltd", "a"), ("", None), ("Bolt", ""), ("Bolt", "")]
    found = {(r["conflict_key"], r["place"]): r for r in analysis.details(sheet(spark, ["Name", "City"], rows), "Name", ["City"]).collect()}
    groups = [found["duplicate_row:Name", k] for k in (1, 2)]
    assert [(g["rows"], g["fields"]) for g in groups] == [([2, 3], ["City"]), ([6, 7], [])]
    assert found["missing_value:Name", 1]["rows"] == [5] and found["missing_value:City", 1]["rows"] == [5, 6, 7]
    pair = found["possible_duplicate_row:Name", 1]
    assert pair["rows"] == [2, 4] and pair["signals"] == ["key_fuzzy", "token_reorder"] and len(found) == 6
