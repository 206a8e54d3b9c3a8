"""Text and attribute functions against Python."""

import json

import pytest
from pyspark.sql import functions as F

from pairloom.functions import attributes as A
from pairloom.functions import text as X

#: A text; cleaned; compact; its numbers; its model codes.
TEXTS = [
    (None, "", "", [], []),
    ("", "", "", [], []),
    ("  A  b ", "a b", "ab", [], []),
    ("Ёлка ЁЖ", "елка еж", "елкаеж", [], []),
    ("ﬁne ½ ＡＢ１２", "fine 1⁄2 ab12", "fine12ab12", [], ["ab12"]),
    ("a\xa0b\u2003c\x1cd\te\nf", "a b c d e f", "abcdef", [], []),
    ("3,5КГ и 7Ё x", "3,5кг и 7е x", "35кги7еx", ["3,5кг"], ["5кг"]),
    ("Чай/май 12.5мм", "чай/май 12.5мм", "чаймай125мм", ["12.5мм"], ["5мм"]),
    ("iPhone 13 Pro-128gb 5G", "iphone 13 pro-128gb 5g", "iphone13pro128gb5g", ["128gb", "13", "5g"], ["pro-128gb"]),
    ("a1b 2 х3", "a1b 2 х3", "a1b2х3", ["2"], ["a1b"]),
    ("12 12 12mm", "12 12 12mm", "121212mm", ["12", "12mm"], ["12mm"]),
    ("болт １２мм", "болт 12мм", "болт12мм", ["12мм"], ["12мм"]),
]


def test_text_functions(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(TEXTS)], "i int, t string")
    c = X.clean_text(F.col("t"))
    rows = df.select("i", c.alias("c"), X.compact(c).alias("k"), X.number_tokens(F.col("t"), True).alias("n"), X.code_tokens(c).alias("m")).collect()
    for r in rows:
        assert (r.c, r.k, r.n, r.m) == TEXTS[r.i][1:]


def test_similarity_and_ratios(spark):
    pairs = [("", ""), ("abc", ""), ("abc", "abd"), ("чай", "май")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [(r.s, r.j) for r in df.select(X.name_similarity(F.col("a"), F.col("b")).alias("s"), X.jaccard(X.name_tokens(F.col("a")), X.name_tokens(F.col("b"))).alias("j")).collect()]
    assert got == [(1.0, 0.0), (0.0, 0.0), (pytest.approx(2 / 3), 0.0), (pytest.approx(2 / 3), 0.0)]
    assert spark.range(1).select(X.sigmoid(F.lit(100.0)), X.sigmoid(F.lit(0.0))).first()[1] == 0.5


def test_attributes(spark):
    texts = [None, "", "[1]", "{bad", '{"B":"x","a":" Y "}', '{"a":null,"b":""}', '{"n":[1,"x"],"t":true}', '{"А":"1","а":"2"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", A.json_attributes(F.col("t")).alias("j"), A.cleaned_attributes(F.col("t")).alias("c"), A.python_attributes(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.j for r in rows[:4]] == [{}] * 4
    assert rows[4].c == {"b": "x", "a": "y"} and rows[5].c == {}
    assert rows[6].p == {"n": str([1, "x"]), "t": "True"} and rows[6].j["t"] == "true"
    assert rows[7].c == {"а": "1"}
    left, right = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("3"))
    assert list(spark.range(1).select(*[A.attribute_state(left, right, k) for k in "abc"]).first()) == [1, 2, 0]
    assert json.loads(spark.range(1).select(A.sorted_json(left)).first()[0]) == {"a": "1", "b": "2"}


def test_product_text(spark):
    df = spark.createDataFrame([("N", None, '{"k":"v","l":"w"}'), (None, "c", None)], "n string, c string, a string")
    got = [r[0] for r in df.select(A.product_text(F.col("n"), F.col("c"), A.json_attributes(F.col("a")))).collect()]
    assert got == ["Name: N Category: <NULL> Attributes: k: v l: w", "Name:  Category: c Attributes: "]
