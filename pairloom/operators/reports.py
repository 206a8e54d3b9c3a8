"""Reports: the hardest errors, the heuristics' baselines, counts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.attributes import sorted_json
from pairloom.plans import tables

from . import metrics
from .scoring import heuristics


def hard_errors(scored: DataFrame, records: DataFrame, top: int = 100, score: str = "prediction") -> DataFrame:
    """The highest-rated negatives and the lowest-rated positives, with both cards' names and attributes.

    The rows are cut off first, so at most 2 * top pairs meet the items.
    """
    fp = scored.where("target < 0.5").orderBy(F.desc(score), "id1", "id2").limit(top).withColumn("kind", F.lit("false_positive"))
    fn = scored.where("target >= 0.5").orderBy(score, "id1", "id2").limit(top).withColumn("kind", F.lit("false_negative"))
    both = fp.unionByName(fn).select("kind", "id1", "id2", F.col(score).alias("score"))
    card = records.select("id", "name", sorted_json(F.col("attrs")).alias("attributes"))
    for side in ("1", "2"):
        own = card.select(F.col("id").alias(f"id{side}"), F.col("name").alias(f"name{side}"), F.col("attributes").alias(f"attributes{side}"))
        both = both.join(own, f"id{side}", "left")
    return both


def baseline_report(features: DataFrame, weight: str | None = None) -> DataFrame:
    """experiment, category, pairs, positives, positive_rate, average_precision of each heuristic.

    weight: the column that tells how many pairs a row stands for.
    """
    known = heuristics()
    more = [weight] if weight else []
    features = tables.written(features.select("category", "target", *more, *[c.alias(n) for n, c in known.items()]), "heuristics")
    out = None
    for name in known:
        one = metrics.average_precision_by(features.select("category", "target", *more, F.col(name).alias("score")), "category", weight=weight)
        one = one.select(F.lit(name).alias("experiment"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out


def experiment_summary(report: DataFrame) -> DataFrame:
    """experiment, macro_average_precision over the categories that have positives."""
    return report.groupBy("experiment").agg(F.avg("average_precision").alias("macro_average_precision"))


def histogram(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).orderBy(key)
