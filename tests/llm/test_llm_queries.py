"""The registered queries: their SQL, the columns that they promise, and the entry point."""

import duckdb
import pytest
from llm_cases import SF

import __spark_entry__ as entry
from pairloom.llm import queries

PROMISED = {
    "op1": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2": "doc_id n_bytes n_tokens over_limit",
    "op3": "doc_id",
    "op4": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op5": "doc_id held_out score predicted",
    "op6": "doc_id start n_tokens ids_crc32",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "doc_id n_shingles component_id",
    "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str(list(r)) for r in found.fetchall())


def test_every_operator_is_registered(spark):
    known = entry.queries()
    assert "pipeline" in known
    for n, columns in PROMISED.items():
        (name,) = [q for q in known if q.startswith(f"{n}_")]
        df = known[name](spark, SF)
        assert df.columns[: len(columns.split())] == columns.split()
        if n in ("op1", "op2", "op4", "op5", "op6", "op7", "op8", "op10"):
            assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
