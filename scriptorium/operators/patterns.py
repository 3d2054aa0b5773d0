"""Which of many patterns stand in many texts: one automaton for a group of patterns, each text read once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most patterns of one automaton.
GROUP = 10_000


def _gathered(df: DataFrame, by: str, column: str, most: int) -> DataFrame:
    """(by, column as an array): the distinct values that rows of one key have within a batch, at most so many in a row."""
    key_type, value_type = df.schema[by].dataType.simpleString(), df.schema[column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # nulls are a group too
            table = pa.Table.from_batches([batch]).group_by([by, column]).aggregate([])
            order = pc.sort_indices(table, [(by, "ascending")])
            table = table.take(order).combine_chunks()
            keys, values = (table.column(c).chunk(0) if len(table) else pa.array([], table.schema.field(c).type) for c in (by, column))
            cuts, last = [0], None
            for k, key in enumerate(keys.to_pylist()):
                if k and (key != last or k - cuts[-1] >= most):
                    cuts.append(k)
                last = key
            ends = [*cuts[1:], len(keys)]
            if len(keys):
                lists = pa.ListArray.from_arrays(pa.array([*cuts, ends[-1]], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(cuts)), lists], names=[by, column])

    return df.select(by, column).mapInArrow(run, f"{by} {key_type}, {column} array<{value_type}>")


def occurrences(texts: DataFrame, wanted: DataFrame, by: str, in_text: bool = False) -> DataFrame:
    """(by, pattern), or (by, text, pattern): the patterns of wanted(by, pattern) that stand as substrings in texts(by, text) of the same key; distinct.

    Texts and patterns travel in groups, so a key has a row for each group of
    texts and group of patterns, and no text is paired with a single pattern.
    A key with many texts is only long, not wide: its groups of texts can be
    dealt apart. Null and empty patterns and texts occur nowhere.
    """
    groups = _gathered(texts.filter("text <> ''"), by, "text", GROUP)
    lists = _gathered(wanted.filter("pattern <> ''").select(by, "pattern").distinct().repartition(by).sortWithinPartitions(by), by, "pattern", GROUP)
    kind = wanted.schema[by].dataType.simpleString()
    columns = (by, "text", "pattern") if in_text else (by, "pattern")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = None, None
        for batch in batches:
            keys, rows = batch.column(0), []
            for k, (lines, patterns) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if patterns != known:
                    known, automaton = patterns, ahocorasick.Automaton(ahocorasick.STORE_INTS)
                    for i, p in enumerate(patterns):
                        automaton.add_word(p, i)
                    automaton.make_automaton()
                hits = ((t, i) for t, line in enumerate(lines) for _, i in automaton.iter(line)) if in_text else ((0, i) for line in lines for _, i in automaton.iter(line))
                rows += [(k, lines[t], patterns[i]) for t, i in dict.fromkeys(hits)]
            if rows:
                at, line, pattern = (pa.array(x) for x in zip(*rows, strict=True))
                found = [keys.take(at), line, pattern] if in_text else [keys.take(at), pattern]
                yield pa.RecordBatch.from_arrays(found, names=list(columns))

    return groups.join(lists, by).select(by, "text", "pattern").mapInArrow(run, f"{by} {kind}, " + ", ".join(f"{c} string" for c in columns[1:])).distinct()


def in_groups(patterns: DataFrame) -> DataFrame:
    """patterns(pattern) with the group that each is of; for texts and patterns without a key, with as many groups as are needed."""
    count = patterns.count()
    return patterns.withColumn("_group", F.pmod(F.xxhash64("pattern"), F.lit(count // GROUP + 1)).cast("int"))


def anywhere(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern): patterns(pattern) as substrings of texts(text), all against all; each text is read once for every GROUP of patterns."""
    wanted = in_groups(patterns.filter("pattern <> ''").distinct())
    groups = sorted(r["_group"] for r in wanted.select("_group").distinct().collect())
    every = texts.select("text").distinct()
    spread = every.withColumn("_group", F.explode(F.array(*map(F.lit, groups)))) if groups else every.withColumn("_group", F.lit(0))
    return occurrences(spread, wanted, "_group", in_text=True).select("text", "pattern")
