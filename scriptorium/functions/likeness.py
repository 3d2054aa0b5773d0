"""How alike two texts are, and what bounds it without Python."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Without braces and backslashes, white space as single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[{}\\]", ""), r"\s+", " ")))


def similarity(a: Column, b: Column) -> Column:
    """Twice the matching characters by all characters, of longest common blocks; null is empty. Of equal texts, and where one is empty, no Python is asked."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    a, b = (F.coalesce(c, F.lit("")) for c in (a, b))
    plain = F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0)
    return F.coalesce(plain, ratio(F.when(plain.isNull(), a), F.when(plain.isNull(), b)))


def most_alike(a: Column, b: Column) -> Column:
    """An upper bound of similarity(a, b): no character can match more often than it occurs in either; 1 for empty texts."""
    often = lambda text, c: F.length(text) - F.length(F.replace(text, c))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(often(a, c), often(b, c))))
    return F.coalesce(F.try_divide(2 * common, F.length(a) + F.length(b)), F.lit(1.0))
