"""Conversion, keys and small functions against worked examples."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions import convert, text


def values(spark, make, cells):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("c"))).collect()]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (convert.to_int, {"yes": 1, "No": 0, "12.5": 125, "1,234": 1234, "abc": 0, "": None, None: None, "-": None, "1-2": None, " -7 ": -7}),
        (convert.to_number, {"$1,234.50": 1234.5, "1.234,50": 1234.5, "1,234": 1234.0, "0,50": 50.0, "1,50": 1.5, "1e5": 15.0, "1,234,56": None, "-1 234.5": -1234.5, "x": None, "": None}),
        (convert.date_text, {"2024-3-1": "2024-03-01", "2024/03/01": "2024-03-01", "3/1/2024": "2024-03-01", "3-1-2024": "2024-03-01", "1.3.2024": "2024-03-01", "2024-02-30": None, "yesterday": None}),
        (convert.to_datetime, {"2024-03-01T10:00": "2024-03-01 10:00", "1.3.2024 9 pm": "2024-03-01 9", "1.3.2024": "2024-03-01"}),
        (text.compare_key, {"Acme Steel Pte. Ltd.": "acme steel", "Ltd": "ltd", "A-B  c": "a b c", "李 公司": "李 公司", "Straße": "strasse", None: ""}),
        (text.token_signature, {"Steel Works Acme": "acme steel works", "b a a": "a a b"}),
        (text.snake, {" Tax ID (new) ": "tax_id_new"}),
        (text.slug, {"Customer Group/2": "customer-group-2"}),
        (text.strip, {"  a\t\n": "a"}),
        (text.extract_json, {'x {bad} {"a": [1, {"b": 2}]} y': '{"a": [1, {"b": 2}]}', "none": None, "": None}),
        (text.error_message, {'{"message": "no \\"x\\""': 'no "x"', "plain": "plain"}),
        (convert.is_int, {"1,000": True, "-5": True, "1.0": False}),
        (convert.is_float, {"1.5": True, "1e5": True, "5": False, "1,000.5": True}),
    ],
)
def test_examples(spark, make, cases):
    assert values(spark, make, list(cases)) == list(cases.values())


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("", "ab", 2), ("acme", "acem", 2), ("kitten", "sitting", 3), ("北京", "北京市", 1)])
def test_distances(spark, a, b, d):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert rows.select(F.levenshtein("a", "b")).first()[0] == d
    for k in range(5):
        assert rows.select(text.within_distance(F.col("a"), F.col("b"), k)).first()[0] == (d <= k)
