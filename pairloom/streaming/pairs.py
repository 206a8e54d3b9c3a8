"""Features and scores of arriving pairs: a stream of pairs joined to the static items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.operators.features import AttributeSpec, pair_features
from pairloom.sources.io import PAIRS


def stream_pairs(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Pair files as they arrive in a folder."""
    return spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_features(pairs: DataFrame, records: DataFrame, specs: list[AttributeSpec] = ()) -> DataFrame:
    """Features of streamed pairs. Nothing is kept between batches: each pair meets its two items and is done.

    Splits, quotas and average precision need all pairs at once and stay with batches.
    """
    return pair_features(pairs, records, specs)


def write_stream(stream: DataFrame, path: str, checkpoint: str):
    """Appends what there is to a Parquet table and stops; a restart goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
