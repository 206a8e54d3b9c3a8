"""The corpus pipeline: quality rules, near duplicates, repeated passages, the mix of sources, and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, and pass other columns on, whatever their
names. Null and repeated identifiers pass every stage as said there; an empty table passes as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import jaccard, mixing, packing, passages, quality, shared, tokens
from pairloom.llm.recipes import PIPELINE_MIX

END_ID = 2
#: Texts of no shingles: null, empty, or nothing but the characters that part words.
WORDLESS = r"\A[\x09-\x0D\x20]*\z"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every rule; the others go.

    Null, empty and very short texts go, by the rule on words. Each row is judged by its own text, so rows that
    repeat stay or go together, and identifiers, null or repeated, have no say.
    """
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the least identifier stays; rows repeated as a whole stay once.

    Texts are grouped, not identifiers, so each row is decided by its own text, and a group of rows without
    identifiers keeps one of them. Of one identifier's texts in a group that of the least hash stays. Rows
    without words have no near copies and stay.
    """
    key, wordless = F.xxhash64("text"), F.coalesce(F.col("text"), F.lit("")).rlike(WORDLESS)
    found = jaccard.join(docs.select(key.alias("__key"), "text"), "__key").select("__key", "component_id").distinct()
    # Each text's least identifier, null last, before the join: a frequent text is one row.
    least = docs.where(~wordless).groupBy(key.alias("__key")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"))).alias("least"))
    first = least.join(found, "__key").groupBy("component_id").agg(F.min(F.struct("least", "__key")).alias("first"))
    stays = first.select(F.col("first.least.id").alias("__id"), F.col("first.__key").alias("__key"))
    same = docs["doc_id"].eqNullSafe(stays["__id"]) & (F.xxhash64(docs["text"]) == stays["__key"])
    kept = docs.where(~wordless).join(stays, same, "left_semi").unionByName(docs.where(wordless))
    return kept.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that an earlier document holds; one of which nothing is left goes.

    Earlier is of a smaller identifier: rows of one identifier, or of none, take nothing from each other, and rows
    without one come last. A null text stays, an empty one goes. A character that a cut halves goes as a whole.
    """
    cut = passages.without(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where("text IS NULL OR trim(text) <> ''").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; none is taken twice.

    Null languages and sources are leaves of their own. Rows of one identifier and text are taken or left
    together; rows without identifiers, or that repeat one, are told apart by their texts. Null and empty texts
    cost nothing and go with the prefix that they lie in.
    """
    own = docs.withColumnRenamed("mix", "__own_mix")
    return mixing.mixed(own, PIPELINE_MIX).drop("mix").withColumnRenamed("__own_mix", "mix").select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences: one of the end id alone for a null or empty text.

    Rows that repeat, or share an identifier, are documents of their own.
    """
    return packing.packed(packing.pieces(docs, tokens.vocabulary("word_bpe_49k.json"), END_ID))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: SQL has neither the tokenizer nor the packing of the last stage, and no equal of a halved character's removal; the
#: stages are tested against brute force, those with SQL of their own in the registered queries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each as a table in the shared folder; what a stage needed goes when it is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with shared.scope(spark):
            docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}", kept=True)
        if last is not None:
            shared.dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
