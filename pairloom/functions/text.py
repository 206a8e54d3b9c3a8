"""Text functions of item cards, as column expressions; only Unicode normalization needs an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "<NULL>"
#: What counts as a number with its unit, and as a letter or digit of a compact name.
NUMBER = r"(?<!\w)\d+(?:[.,]\d+)?(?:[a-zа-я]+)?(?!\w)"
NOT_COMPACT = "[^0-9a-zа-я]+"
NOT_CODE = "[^0-9a-zа-я-]+"
BLANKS = r"(?U)[\s\x1c-\x1f]+"
CODE_LENGTH = 3


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC of each text; there is no built-in function for it."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(values: pd.Series) -> pd.Series:
    """The same for each text of an array: an Arrow function can't stand in a lambda."""
    return values.map(lambda a: None if a is None else [v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in a])


def clean_each(texts: Column, normalize: bool = True) -> Column:
    """An array of texts, each cleaned."""
    return F.transform(nfkc_each(texts) if normalize else texts, lambda x: clean_text(x, False))


def or_null_name(c: Column) -> Column:
    """A category, or the sentinel for a missing one."""
    return F.coalesce(c, F.lit(NULL))


def clean_text(c: Column, normalize: bool = True) -> Column:
    """Null is empty; NFKC, lower case, one letter for both e's, single spaces, none at the ends.

    normalize=False leaves NFKC out and so stays in the JVM: right for ASCII and for text normalized before.
    """
    c = F.coalesce(c, F.lit(""))
    c = F.translate(F.lower(nfkc(c) if normalize else c), "ё", "е")
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def compact(cleaned: Column) -> Column:
    """A cleaned text without anything but letters and digits."""
    return F.regexp_replace(cleaned, NOT_COMPACT, "")


def number_tokens(raw: Column, normalize: bool = False) -> Column:
    """The different numbers of a raw text, with their units, each cleaned; sorted."""
    found = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit("(?iU)" + NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(clean_each(found, normalize)))


def code_tokens(cleaned: Column) -> Column:
    """The different model codes of a cleaned text: three characters or more, with a letter and a digit; sorted.

    A definition of this library's: the helper that the pipeline was written around is not public.
    """
    words = F.split(cleaned, NOT_CODE)
    return F.array_sort(F.array_distinct(F.filter(words, lambda x: (F.length(x) >= CODE_LENGTH) & x.rlike("[0-9]") & x.rlike("[a-zа-я]"))))


def name_tokens(cleaned: Column) -> Column:
    return F.array_distinct(F.filter(F.split(cleaned, NOT_COMPACT), lambda x: x != ""))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def name_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer cleaned name; 1 if both are empty. A definition of this library's."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b).cast("double") / longest.cast("double"))


def sigmoid(x: Column, bound: float = 30.0) -> Column:
    """The logistic function of x clipped to +-bound."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def softmax_of_two(a: Column, b: Column) -> Column:
    """The second of two logits' probabilities."""
    return sigmoid(b - a, 700.0)
