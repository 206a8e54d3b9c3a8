"""Attribute maps of item cards."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import NULL, clean_each

MAP = T.MapType(T.StringType(), T.StringType())


def json_attributes(c: Column) -> Column:
    """A JSON object as a map; null, broken JSON and anything but an object are empty. Nested values are JSON text."""
    return F.coalesce(F.from_json(c, MAP), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


@F.pandas_udf(MAP)
def python_attributes(values: pd.Series) -> pd.Series:
    """The same with the values written as Python writes them, and the last of a repeated key kept."""

    def one(v):
        try:
            found = json.loads(v) if v is not None else {}
        except ValueError:
            return {}
        return {k: str(x) for k, x in found.items()} if isinstance(found, dict) else {}

    return values.map(one)


def cleaned_attributes(c: Column, normalize: bool = True) -> Column:
    """Keys and values cleaned, empty values dropped, the first of keys that clean to one kept."""
    found = json_attributes(c)
    pairs = F.zip_with(clean_each(F.map_keys(found), normalize), clean_each(F.map_values(found), normalize), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    full = F.filter(pairs, lambda e: e["value"] != "")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(full, none, lambda held, e: F.when(F.map_contains_key(held, e["key"]), held).otherwise(F.map_concat(held, F.create_map(e["key"], e["value"]))))


def product_text(name: Column, category: Column, attributes: Column) -> Column:
    """``Name: ... Category: ... Attributes: key: value key: value`` of a card; attributes: a map."""
    written = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    return F.concat(F.lit("Name: "), F.coalesce(name, F.lit("")), F.lit(" Category: "), F.coalesce(category, F.lit(NULL)), F.lit(" Attributes: "), F.array_join(written, " "))


def full_text(name: Column, attributes: Column) -> Column:
    """The name and all attribute values."""
    return F.concat_ws(" ", F.coalesce(name, F.lit("")), F.array_join(F.map_values(attributes), " "))


def attribute_state(left: Column, right: Column, key: str) -> Column:
    """0: missing on a side, 1: equal, 2: different."""
    both = F.map_contains_key(left, key) & F.map_contains_key(right, key)
    return F.when(both, F.when(left[key].eqNullSafe(right[key]), 1).otherwise(2)).otherwise(0)


def sorted_json(attributes: Column) -> Column:
    """A map as a JSON object with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attributes))))
