"""Numbers, lists and digests of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| by the larger of both."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))


def listed(text: Column) -> Column:
    """A JSON list of texts as an array; what is no such list is an empty one."""
    return F.coalesce(F.from_json(text if isinstance(text, Column) else F.lit(text), "array<string>"), F.array().cast("array<string>"))


def output_hash(stdout: Column) -> Column:
    return F.substring(F.sha2(stdout, 256), 1, 16)
