"""Views that stand for item cards and pairs, over the test tables; the SQL of each says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.operators import blocks
from pairloom.operators.items import item_records
from pairloom.plans import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cards: ASCII names, two attributes, the type as category."""
    p = table(spark, sf_dir, "part")
    size = F.concat(F.col("p_size").cast("string"), F.lit("mm"))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", "p_brand", size).alias("name"),
        F.to_json(F.struct(F.col("p_brand").alias("brand"), size.alias("size"))).alias("attributes"),
        F.col("p_type").alias("category"),
    )


#: What the pairs of parts have in common, and what a part's card is made of.
BLOCK, CONTENT = ["p_type", "p_name"], ["p_brand", "p_size"]
#: All that a card has but its id.
CARD = ["name", "attributes", "category"]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *BLOCK, *CONTENT)


def pairs_part(spark: SparkSession, sf_dir: str, without: DataFrame | None = None) -> DataFrame:
    """Pairs of parts of one type and name; a match if the brand is the same. without: ids of parts that are in no pair."""
    p = _parts(spark, sf_dir).drop("p_size")
    if without is not None:
        p = p.join(without.select("id"), "id", "left_anti")
    return _pairs(blocks.joined_pairs(p, BLOCK))


def _pairs(joined: DataFrame, *more: Column) -> DataFrame:
    same = (F.col("l.p_brand") == F.col("r.p_brand")).cast("double").alias("target")
    return joined.select("id1", "id2", same, F.col("p_type").alias("category"), *more)


def pairs_with(spark: SparkSession, sf_dir: str, told: DataFrame, *more: Column) -> DataFrame:
    """pairs_part and more columns, made of what ``told`` has of both items by their id: the structs ``l`` and ``r``, null where it has none."""
    return _pairs(blocks.joined_pairs(_parts(spark, sf_dir).drop("p_size").join(told, "id", "left"), BLOCK), *more)


def folded_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs_part folded to a row for each greater end, with counts."""
    return blocks.folded_pairs(_parts(spark, sf_dir), BLOCK, "p_brand").withColumnRenamed("p_type", "category").drop("p_name")


def class_pairs_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs_part as pairs of equal cards with ``weight``."""
    return blocks.class_pairs(_parts(spark, sf_dir), BLOCK, CONTENT, "p_brand").drop(*BLOCK)


def card_classes_part(spark: SparkSession, sf_dir: str, told: DataFrame | None = None) -> DataFrame:
    """Parts of one type and name that have one card, as classes: their card and their ids. told: what classes differ in too, by id; parts without it are left out."""
    p = _parts(spark, sf_dir).drop("p_size").join(items_part(spark, sf_dir), "id")
    more = [] if told is None else [c for c in told.columns if c != "id"]
    p = p if told is None else p.join(told, "id")
    return tables.written(blocks.card_classes(p, BLOCK, ["p_brand", *CARD, *more]), "classes")


def ordered_classes_part(classes: DataFrame) -> DataFrame:
    """pairs_part as pairs of such classes, whose items ``blocks.listed_pairs`` lists."""
    return blocks.ordered_class_pairs(classes, BLOCK, "p_brand")


def soft_target() -> Column:
    return ((F.col("id1") * 7 + F.col("id2") * 13) % 101).cast("double") / 100.0


def pair_score() -> Column:
    return ((F.col("id1") * 31 + F.col("id2") * 17) % 997).cast("double") / 997.0


def soft_pairs(spark: SparkSession, sf_dir: str, without: DataFrame | None = None) -> DataFrame:
    return pairs_part(spark, sf_dir, without).withColumn("target", soft_target())


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_part(spark, sf_dir).select("id1", "id2", pair_score().alias("cross_encoder_score"))


def records_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the parts, written once; their names are ASCII, so nothing is left to normalize."""
    return tables.written(item_records(items_part(spark, sf_dir), normalize=False), "records")


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, one after the other."""
    e = table(spark, sf_dir, "events")
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(before.alias("prev_id"), "event_id").where("prev_id IS NOT NULL")


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: category lang, target toxic, and a score from the lengths."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select(F.col("lang").alias("category"), F.col("toxic").alias("target"), (F.col("n_chars") % 500).cast("double").alias("score"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their next neighbours by number: (id1, id2, target, a, b); a match if the label is the same."""
    v = table(spark, sf_dir, "embeddings")
    steps = v.select(F.col("vec_id").alias("id1"), F.col("embedding").alias("a"), F.col("label").alias("la"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("step"))
    right = v.select(F.col("vec_id").alias("id2"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    return steps.withColumn("id2", F.col("id1") + F.col("step")).join(right, "id2").select("id1", "id2", (F.col("la") == F.col("lb")).cast("int").alias("target"), "a", "b")


#: The same views in SQL, as parts of a WITH list.
SQL = {
    "items_part": """items_part AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_size || 'mm' AS name, p_brand AS brand, p_size || 'mm' AS size, p_type AS category FROM part)""",
    "pairs_part": """pairs_part AS (SELECT a.p_partkey AS id1, b.p_partkey AS id2, (a.p_brand = b.p_brand)::INT::DOUBLE AS target, a.p_type AS category
 FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey)""",
    "soft_pairs": """soft_pairs AS (SELECT id1, id2, ((id1 * 7 + id2 * 13) % 101)::DOUBLE / 100.0::DOUBLE AS target, category FROM pairs_part)""",
    "scores": """scores AS (SELECT id1, id2, ((id1 * 31 + id2 * 17) % 997)::DOUBLE / 997.0::DOUBLE AS cross_encoder_score FROM pairs_part)""",
    "metric_rows": """metric_rows AS (SELECT lang AS category, toxic AS target, (n_chars % 500)::DOUBLE AS score FROM documents JOIN labels USING (doc_id))""",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
