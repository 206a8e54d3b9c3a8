"""Rows that the tests of this folder share."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SF = "/root/testdata/sf0.001"


def rows_of(texts, first=0):
    return [(None if i == "null" else i, t, ["en", "de", None][k % 3], f"src{k % 12}" if k % 7 else None, None if t is None else len(t)) for k, (i, t) in enumerate(texts, first)]
