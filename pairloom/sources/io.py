"""Reading and writing: Parquet, CSV and JSON reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("attributes", T.StringType()), T.StructField("category", T.StringType())])
PAIRS = T.StructType([T.StructField("id1", T.LongType(), False), T.StructField("id2", T.LongType(), False), T.StructField("target", T.DoubleType())])
ATTRIBUTE_STATS = T.StructType([T.StructField("category", T.StringType()), T.StructField("attribute", T.StringType()), T.StructField("pairs_with_attribute_both", T.LongType())])


def read_items(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Item cards; only the columns asked for are read. Attributes given as a struct or map become JSON."""
    df = spark.read.parquet(path)
    kind = dict(df.dtypes).get("attributes", "string")
    if kind != "string":
        df = df.withColumn("attributes", F.to_json("attributes"))
    return df.select(*(columns or ITEMS.fieldNames()))


def read_pairs(spark: SparkSession, path: str, target: bool = True) -> DataFrame:
    return spark.read.parquet(path).select("id1", "id2", *(["target"] if target else []))


def read_attribute_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ATTRIBUTE_STATS).csv(path, header=True)


def items_of(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The items whose id is among ``ids``."""
    return items.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers."""
    return spark.read.parquet(path).count()


def write_parquet(df: DataFrame, path: str, force: bool = True) -> None:
    """A zstd Parquet table; the commit protocol leaves no partial output. force=False keeps a table that is there."""
    df.write.mode("overwrite" if force else "ignore").option("compression", "zstd").parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """A zstd Parquet table that must not be empty: ValueError, and no table, if there are no rows."""
    write_parquet(df, path)
    if not row_count(df.sparkSession, path):
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        raise ValueError(f"there are no rows for {path}")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one_file only for small reports."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: dict, path: str) -> None:
    """A small report as indented JSON, with letters as they are."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2), encoding="utf-8")


def signature(ids: DataFrame, column: str = "id") -> DataFrame:
    """One row that tells whether a set of ids changed: count, sum, least, greatest, and an order-free hash of them."""
    one = ids.select(F.col(column).cast("long").alias("x")).distinct()
    return one.agg(
        F.count("*").alias("n"),
        F.sum("x").cast("long").alias("total"),
        F.min("x").alias("least"),
        F.max("x").alias("greatest"),
        F.bit_xor(F.conv(F.substring(F.md5(F.col("x").cast("string")), 1, 15), 16, 10).cast("long")).alias("hash"),
    )


def source_signature(spark: SparkSession, path: str, ids: DataFrame, column: str = "id") -> DataFrame:
    """``signature`` with the size and the last change of the files that the ids come from."""
    files = spark.read.format("binaryFile").load(path).select("length", "modificationTime")
    about = files.agg(F.sum("length").alias("source_bytes"), F.max("modificationTime").alias("source_changed"))
    return signature(ids, column).crossJoin(F.broadcast(about))  # one row each


def range_signature(ids: DataFrame, column: str = "id", width: int = 1 << 16) -> DataFrame:
    """SHA-256 over the digests of ranges of ``width`` numbers, in their order; a range's is over its ids, a line for each.

    No task sees more than ``width`` ids, or one digest of each range.
    """
    one = ids.select(F.col(column).cast("long").alias("x")).distinct()
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x.cast("string"), F.lit("\n"))), "")
    ranges = one.groupBy(F.floor(F.col("x") / width).alias("k")).agg(F.sha2(lines, 256).alias("digest"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("k", "digest"))), lambda s: s["digest"])
    return ranges.agg(F.sha2(F.array_join(every, ""), 256).alias("sha256"))


def ordered_signature(ids: DataFrame, column: str = "id") -> DataFrame:
    """SHA-256 over the ids in ascending order, a line for each. It gathers all ids in one row: for small sets; see ``signature``."""
    one = ids.select(F.col(column).cast("long").alias("x")).distinct()
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x.cast("string"), F.lit("\n")))
    return one.agg(F.sha2(F.array_join(lines, ""), 256).alias("sha256"))
