import pytest
from llm_cases import SCHEMA, SF, rows_of


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and blank texts, ties, repeated rows, repeated and missing ids, odd characters, and a long text."""
    base = "The quick brown fox jumps over the lazy dog while the rain in the hills keeps falling on the old stone bridge of the town. "
    return [
        (0, None),
        (1, ""),
        (2, "   \n\t "),
        (3, base * 3),
        (4, base * 3),
        (5, base * 3 + "Then it stops."),
        (5, base * 3 + "Then it stops."),
        ("null", base * 3),
        ("null", None),
        (6, "é" * 70 + " ß x <|endoftext|> a  b 'tis 2.0"),
        (7, "aaaa" * 100),
        (8, "aaaa" * 60 + "b"),
        (9, "MIT License! licensed under the Apache License, Version 2.0; GNU General Public License v3"),
        (10, "you idiot you moron"),
        (11, (base + "x" * 5000 + " ") * 40),
        (-12, "négative id, tête à tête " * 12),
        (13, "one two three"),
        (14, "ONE  two\nthree"),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_texts):
    return spark.createDataFrame(rows_of(edge_texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
