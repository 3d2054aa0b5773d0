"""Plain tests for substrings that spare most texts a regular expression."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(text: Column) -> Column:
    """text in lower case; null if it has characters beyond ASCII, since some of these fold to ASCII letters (the Kelvin sign to k)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text))


def may_match(low: Column, stems: Iterable[str]) -> Column:
    """False only if `low` has none of the stems; true where it is null, as folded() is for texts that it can't judge."""
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(s) for s in stems]), F.lit(True))
