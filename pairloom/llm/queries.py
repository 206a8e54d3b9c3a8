"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, licenses, media, mixing, packing, passages, quality, shared, sstable, token_counts, tokens, toxicity
from .recipes import MIX
from .sql import ORACLE_SQL  # noqa: F401

TOKEN_LIMIT = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, sf_dir), tokens.vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    base = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality.judged(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *[q[x].alias(x) for x in names], base.alias("base_failed"), (~base & q["kept"]).alias("kept"), F.array_join(q["failed"], ",").alias("failed_rules"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_token_counts": op2_token_counts,
    "op7_quality_rules": op7_quality_rules,
}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "license.*")
    labels = F.array_distinct(F.transform("base", lambda x: x["label"]))
    more = F.array_distinct(F.transform("found", lambda x: x["label"]))
    weights = F.transform("found", lambda x: x["weight"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        F.array_join(F.sort_array(labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(labels, more)), ",").alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_detections"),
    )


QUERIES["op1_license_scan"] = op1_license_scan


def op4_media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored_documents(documents(spark, sf_dir)))


QUERIES["op4_media_pages"] = op4_media_pages

END_ID = 2


def op6_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sstable.write_shards(documents(spark, sf_dir), tokens.vocabulary("byte_bpe_50k.json"), END_ID)
    return sstable.read_shards(spark, shards)


QUERIES["op6_sorted_string_table"] = op6_sorted_string_table


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digests(passages.removed(documents(spark, sf_dir).select("doc_id", "text")))


QUERIES["op10_suffix_array_dedup"] = op10_suffix_array_dedup


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES["op8_ngram_jaccard_join"] = op8_ngram_jaccard_join


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mixed(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), MIX)
    return taken.select("doc_id", "mix.*")


def op9_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir), tokens.vocabulary("word_bpe_49k.json"), END_ID)
    return packing.packed(cut)


QUERIES |= {"op3_source_mixing": op3_source_mixing, "op9_sequence_packing": op9_sequence_packing}


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts, labels, ids = toxicity.sample(docs, marks)
    model = toxicity.fit(texts, labels)
    found = shared.written(toxicity.logits(docs, model), "toxicity-logits")
    return toxicity.decided(found, toxicity.calibrated(found, marks, model, toxicity.learned(ids)))


QUERIES["op5_toxicity"] = op5_toxicity
