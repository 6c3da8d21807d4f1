"""Steps that once did far more work than their input asks for; each test failed before its mending."""

import time

from pyspark.sql import functions as F

from tabulon import queries
from tabulon.functions import text
from tabulon.operators import neardup

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_folding_a_long_text_costs_little_more_than_its_lower_case(spark):
    """each letter of a text was held against a class of more than a hundred letters, or looked up among as many."""
    words = F.repeat(F.lit("ein langer Text von Buchstaben "), 1000)
    made = lambda tail: spark.range(0, 160, 1, 1).select(F.concat(words, F.col("id").cast("string"), F.lit(tail)).alias("t"))

    def seconds(rows, of):
        least = []
        for _ in range(2):
            begun = time.time()
            rows.agg(F.sum(F.length(of("t")))).collect()
            least.append(time.time() - begun)
        return min(least)

    lower = seconds(made("s"), F.lower)
    folded = [seconds(made(tail), text.casefold) for tail in "sß"]
    assert max(folded) < 10 * lower + 0.5, (lower, folded)
    got = spark.createDataFrame([("Straße ΣΑΣ ŉﬁ!",), ("",), (None,), ("ß",), ("plain",), ("ſİßß",)], "t string").select(text.casefold("t")).collect()
    assert [r[0] for r in got] == ["strasse σασ ʼnfi!", "", "", "ss", "plain", "si̇ssss"]


def test_severity_needs_no_lists_of_rows(spark):
    """the rows and texts of each group were joined on, only to be counted."""
    assert "Join" not in plan(queries.QUERIES["duplicate_severity"](spark, DATA))


def test_groups_fold_each_key_once(spark):
    """keys were folded anew for the facts, the rows and the texts of a group; now only a group's shown key is."""
    assert plan(queries.QUERIES["duplicate_groups"](spark, DATA)).count("RLIKE") == 1


def test_what_differs_needs_no_lists_of_rows(spark):
    """F8: the rows and texts of each group were joined on, and then not shown."""
    assert "Join" not in plan(queries.QUERIES["duplicate_differing"](spark, DATA))


def test_json_in_a_long_reply_takes_one_walk(spark):
    """the reply was cut into letters anew for each of its letters and each brace."""
    reply = F.concat(F.repeat(F.lit("prose "), 1000), F.lit("{no} }{"), F.lit('{"a": {"b": '), F.col("id").cast("string"), F.lit("}} } done"))
    found = spark.range(0, 40, 1, 1).select("id", F.get_json_object(text.extract_json(reply), "$.a.b").alias("b"))
    found.limit(1).collect()
    begun = time.time()
    assert all(int(r.b) == r.id for r in found.collect())
    assert time.time() - begun < 3


def test_near_duplicate_keys_fold_and_search_a_text_once(spark):
    """comparison key and signature each folded the text anew, several times over, and words were sorted by a lambda."""
    rows = neardup.keyed_rows(spark.createDataFrame([(2, " Straße b a LTD ")], "__row long, name string"), "name")
    made = plan(rows)
    assert made.count("RLIKE") == 1 and made.count("(?:pte|") == 1 and "array_sort" not in made
    assert rows.first().asDict() == {"__row": 2, "value": "Straße b a LTD", "ckey": "strasse b a", "signature": "a b strasse", "dkey": "strasse b a ltd"}


def test_names_of_a_tree_do_not_pass_through_the_driver(spark):
    """the names were broadcast in each round, as their files are small."""
    made = queries.QUERIES["tree_cycle"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in made and "SortMergeJoin" in made
