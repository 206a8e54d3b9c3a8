"""Average precision: overall, by group, and macro averages under three rules for groups without positives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.plans import tables

#: Parts that the scores are cut in, so that no task orders all scores of a group.
PARTS = 64


def _curve(groups: DataFrame, by: list[str], score: str) -> DataFrame:
    """Running counts of positives and rows over falling scores; ties are one step already."""
    w = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return groups.withColumn("ctp", F.sum("tp").over(w)).withColumn("cn", F.sum("n").over(w))


def _summed(curve: DataFrame, by: list[str]) -> DataFrame:
    positives = F.sum("tp")
    area = F.sum(F.col("tp").cast("double") * F.col("ctp").cast("double") / F.col("cn").cast("double"))
    return curve.groupBy(*by).agg(
        F.sum("n").cast("long").alias("pairs"),
        positives.cast("long").alias("positives"),
        (positives.cast("double") / F.sum("n").cast("double")).alias("positive_rate"),
        F.when(positives > 0, area / positives.cast("double")).alias("average_precision"),
    )


def _steps(df: DataFrame, by: list[str], label: str, score: str, weight: str | None) -> DataFrame:
    n = F.col(weight) if weight else F.lit(1).cast("long")
    return df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long") * n).alias("tp"), F.sum(n).alias("n"))


def _precision(df: DataFrame, by: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """The curve is cut at quantiles of the scores, each group's part summed by itself and shifted by the parts above.

    Scores are summed up once, as a table of different scores, which everything else reads.
    """
    steps = tables.written(_steps(df, by, label, score, weight), "scores")
    cuts = sorted(set(steps.approxQuantile(score, [i / PARTS for i in range(1, PARTS)], 1 / (4 * PARTS))))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(score))) if cuts else F.lit(0)
    steps = steps.withColumn("part", F.when(F.col(score).isNotNull(), place).otherwise(-1))
    above = W.partitionBy(*by, F.lit(0)).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    sums = steps.groupBy(*by, "part").agg(F.sum("tp").alias("ptp"), F.sum("n").alias("pn"))
    zero = F.lit(0).cast("long")
    shifts = sums.select(*[F.col(c).alias(f"shift_{c}") for c in by], F.col("part").alias("shift_part"), F.coalesce(F.sum("ptp").over(above), zero).alias("stp"), F.coalesce(F.sum("pn").over(above), zero).alias("sn"))
    same = F.lit(True)
    for c in [*by, "part"]:
        same = same & F.col(c).eqNullSafe(F.col(f"shift_{c}"))
    curve = _curve(steps, [*by, "part"], score).join(shifts, same)
    return _summed(curve.withColumn("ctp", F.col("ctp") + F.col("stp")).withColumn("cn", F.col("cn") + F.col("sn")), by)


def average_precision_by(df: DataFrame, by: str, label: str = "target", score: str = "score", weight: str | None = None) -> DataFrame:
    """by, pairs, positives, positive_rate, average_precision; the last is null for a group without positives.

    weight: the column that tells how many pairs a row stands for.
    """
    return _precision(df, [by], label, score, weight)


def average_precision(df: DataFrame, label: str = "target", score: str = "score") -> DataFrame:
    """One row over all pairs."""
    return _precision(df, [], label, score)


def macro(by_group: DataFrame, rule: str = "skip") -> DataFrame:
    """The plain mean of the groups' average precision.

    rule: "skip" leaves out groups without positives, "two_classes" those of one class (ValueError if none is
    left), "zero" counts groups without positives as 0.
    """
    ap = F.col("average_precision")
    if rule == "skip":
        used = by_group.where(ap.isNotNull())
    elif rule == "two_classes":
        used = by_group.where((F.col("positives") > 0) & (F.col("positives") < F.col("pairs")))
        if not used.limit(1).count():
            raise ValueError("no group has both classes")
    elif rule == "zero":
        used = by_group.withColumn("average_precision", F.coalesce(ap, F.lit(0.0)))
    else:
        raise ValueError(f"no such rule: {rule}")
    return used.agg(F.avg("average_precision").alias("macro_average_precision"), F.count("*").alias("categories"))


def throughput(pairs: int, seconds: float) -> float | None:
    return pairs / seconds if seconds else None
