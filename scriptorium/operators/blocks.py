"""Rows in order, in blocks that one task can hold, so that a key with a large share of all rows is split.

Rows are dealt by ranges of (key, order). A key's rows lie in one block or in
several that follow one another, and no border is inside a group of rows that
agree in key and order. Only one key goes on over a border: what a block has to
know of the blocks before it is a row for each key and block at most, and no
more than twice the number of blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.tables import stored

BLOCK = "_block"


def in_blocks(df: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """df with _block, stored; blocks: how many, by default as many as a shuffle has."""
    cols = [F.col(c) for c in (*keys, *order)]
    dealt = df.repartitionByRange(*cols) if blocks is None else df.repartitionByRange(blocks, *cols)
    return stored(dealt.withColumn(BLOCK, F.spark_partition_id()))


def over_borders(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of keys that lie in several blocks."""
    several = rows.groupBy(*keys).agg(F.min(BLOCK).alias("_low"), F.max(BLOCK).alias("_high")).filter("_low < _high").select(*keys)
    return _met(rows, several, keys, "left_semi")


def with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what carry(*keys, _block, ...) says of their key and block, or null; carry has only keys over borders."""
    return _met(rows, carry, [*keys, BLOCK], "left")


def _met(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join on equal or both null; few has at most two rows for each block."""
    renamed = few.withColumnsRenamed({c: f"_its_{c}" for c in on})
    same: Column = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_its_{c}")) for c in on])
    return rows.join(F.broadcast(renamed), same, how).drop(*[f"_its_{c}" for c in on])


def so_far(rows: DataFrame, keys: list[str], order: list[str], marks: dict[str, Column]) -> DataFrame:
    """rows of in_blocks() with, for each mark, the last of its values that is not null, up to and with the row in its key."""
    at = F.struct(*order)
    last = [F.max_by(mark, F.when(mark.isNotNull(), at)).alias(f"_last_{name}") for name, mark in marks.items()]
    blocks_before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ends = over_borders(rows, keys).groupBy(*keys, BLOCK).agg(*last)
    carry = ends.select(*keys, BLOCK, *[F.last(f"_last_{name}", ignorenulls=True).over(blocks_before).alias(f"_carried_{name}") for name in marks])
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    found = with_carry(rows.withColumns({f"_here_{name}": F.last(mark, ignorenulls=True).over(within) for name, mark in marks.items()}), carry, keys)
    return found.withColumns({name: F.coalesce(f"_here_{name}", f"_carried_{name}") for name in marks}).drop(*[f"_{part}_{name}" for part in ("here", "carried") for name in marks])


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows of in_blocks() with their number within their key, from 1 on."""
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = over_borders(rows, keys).groupBy(*keys, BLOCK).agg(F.count("*").alias("_n"))
    carry = sizes.select(*keys, BLOCK, F.sum("_n").over(before).alias("_before"))
    here = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*order))
    return with_carry(rows.withColumn("_here", here), carry, keys).withColumn(name, F.col("_here") + F.coalesce("_before", F.lit(0))).drop("_here", "_before")
