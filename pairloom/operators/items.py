"""Item records and texts, derived once for each item and joined to pairs afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import attributes as A
from pairloom.functions import text as X


def item_records(items: DataFrame, normalize: bool = True) -> DataFrame:
    """id, category, name, name_clean, name_compact, name_len, attrs, numbers, codes, tokens."""
    base = items.select(
        "id",
        X.or_null_name(F.col("category")).alias("category"),
        F.coalesce("name", F.lit("")).alias("name"),
        X.clean_text(F.col("name"), normalize).alias("name_clean"),
        A.cleaned_attributes(F.col("attributes"), normalize).alias("attrs"),
    )
    whole = A.full_text(F.col("name"), F.col("attrs"))
    base = base.withColumn("full", whole).withColumn("full_clean", X.clean_text(F.col("full"), normalize))
    return base.select(
        "id",
        "category",
        "name",
        "name_clean",
        X.compact(F.col("name_clean")).alias("name_compact"),
        F.length("name").alias("name_len"),
        "attrs",
        X.number_tokens(F.col("full"), normalize).alias("numbers"),
        X.code_tokens(F.col("full_clean")).alias("codes"),
        X.name_tokens(F.col("name_clean")).alias("tokens"),
    )


def item_texts(items: DataFrame, as_python: bool = False) -> DataFrame:
    """id, text, category: the card written out for a text scorer. as_python: nested values as Python writes them."""
    found = A.python_attributes(F.col("attributes")) if as_python else A.json_attributes(F.col("attributes"))
    return items.select("id", A.product_text(F.col("name"), F.col("category"), found).alias("text"), X.or_null_name(F.col("category")).alias("category"))


def joined_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Every pair with both items as the structs ``l`` and ``r``. The job fails at a pair whose item is missing.

    ``checks.require_items`` tells all missing ids beforehand.
    """
    columns = F.struct(*items.columns)
    left = items.select(F.col("id").alias("id1"), columns.alias("l"))
    right = items.select(F.col("id").alias("id2"), columns.alias("r"))
    both = pairs.join(left, "id1", "left").join(right, "id2", "left")
    found = lambda side, i: F.when(F.col(side).isNull(), F.raise_error(F.concat(F.lit("id without an item: "), F.coalesce(F.col(i).cast("string"), F.lit("null"))))).otherwise(F.col(side))
    return both.withColumn("l", found("l", "id1")).withColumn("r", found("r", "id2"))


def named(items: DataFrame) -> DataFrame:
    """id and ``c``, the category or the sentinel."""
    return items.select("id", X.or_null_name(F.col("category")).alias("c"))


def fallback_category(first: Column, second: Column) -> Column:
    """What ``with_category`` says of two items' ``c``, null where the item is absent."""
    return F.coalesce(first, second, F.lit(X.NULL))


def with_category(pairs: DataFrame, items: DataFrame, fallback: bool = True) -> DataFrame:
    """pairs with the first item's category; if that item is absent, with the second's; else the sentinel.

    An item without a category has the sentinel, and no fallback.
    """
    cards = named(items)
    out = pairs.join(cards.select(F.col("id").alias("id1"), F.col("c").alias("c1")), "id1", "left")
    if fallback:
        out = out.join(cards.select(F.col("id").alias("id2"), F.col("c").alias("c2")), "id2", "left")
    found = fallback_category(F.col("c1"), F.col("c2")) if fallback else X.or_null_name(F.col("c1"))
    return out.select(*pairs.columns, found.alias("category"))
