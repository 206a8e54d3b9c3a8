"""Checks that raise: missing ids and columns, repeated keys, overlaps, mixed components, bad arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_ids(*pairs: DataFrame) -> DataFrame:
    """The different ids of all pairs' both ends, as ``id``."""
    out = None
    for p in pairs:
        both = p.select(F.col("id1").alias("id")).union(p.select("id2"))
        out = both if out is None else out.union(both)
    return out.distinct()


def missing_ids(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of the pairs that no item has."""
    return pair_ids(pairs).join(items.select("id"), "id", "left_anti")


def require_items(pairs: DataFrame, items: DataFrame) -> None:
    """KeyError with the count and the ten least of the missing ids."""
    gone = missing_ids(pairs, items)
    first = [r["id"] for r in gone.orderBy("id").limit(10).collect()]
    if first:
        raise KeyError(f"{gone.count()} ids have no item, the first: {first}")


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"{what}: there are no rows")


def require_columns(df: DataFrame, names: list[str]) -> None:
    if gone := sorted(set(names) - set(df.columns)):
        raise ValueError(f"columns are missing: {gone}")


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{what}: {keys} are not unique")


def require_disjoint(train: DataFrame, val: DataFrame) -> None:
    """AssertionError if an item is in both."""
    if pair_ids(train).join(pair_ids(val), "id", "left_semi").limit(1).count():
        raise AssertionError("train and validation share items")


def require_one_category(pairs: DataFrame, component: str = "component") -> None:
    """ValueError if a component has pairs of several categories."""
    mixed = pairs.groupBy(component).agg(F.min("category").alias("a"), F.max("category").alias("b")).where("a <> b")
    if row := mixed.limit(1).collect():
        raise ValueError(f"component {row[0][0]} has several categories")


def require(held: bool, message: str) -> None:
    if not held:
        raise ValueError(message)
