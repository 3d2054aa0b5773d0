"""Line deduplication by pairwise alignment.

Documents meet through runs of lines: from each line on and up to each line,
the shortest run of consecutive lines that has BLOCK_WORDS words is named by a
hash of its lines' hashes. Every line of a block that may be deleted lies in
such a run inside the block: those that the run from its first line on doesn't
have are the last of one. Documents without a run in common need not be
compared. Runs that most documents lack are
the rare ones that link; one that several have links each of them with the
first document that has it, so a group of n documents gives at most n - 1
pairs for each of its runs, however frequent it is. Pairs are aligned by
patience diff, on line hashes, and the common blocks of enough words are
deleted from the later document. What is left of it is aligned again, so that
blocks which moved are found too.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import text as tx
from scriptorium.llm.store import stored

#: Words of a block that is deleted, and of the runs by which documents meet.
BLOCK_WORDS = 20

LINES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("runs", pa.list_(pa.int64()))])
GONE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("gone", pa.list_(pa.int32()))])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
RESULT_TEXT = RESULT.append(pa.field("text", pa.string()))


def _lines(chunk: tx.Chunk) -> dict:
    starts, ends, doc = chunk.lines
    hashes = tx.hash_spans(chunk.buf, starts, ends)
    words = np.searchsorted(chunk.words.starts, ends) - np.searchsorted(chunk.words.starts, starts)
    size = np.bincount(doc, minlength=len(chunk))
    before = np.concatenate([[0], np.cumsum(words)])
    # the run from line k on ends before line end[k], the one up to line k begins with line begin[k], if its document has so many words
    last = np.cumsum(size)
    end = np.searchsorted(before, before[:-1] + BLOCK_WORDS)
    begin = np.searchsorted(before, before[1:] - BLOCK_WORDS, "right") - 1
    onward, up_to = np.flatnonzero(end <= last[doc]), np.flatnonzero(begin >= (last - size)[doc])
    at, stop = np.concatenate([onward, begin[up_to]]), np.concatenate([end[onward], up_to + 1])
    runs = tx.Prefixes(hashes).hash(at, stop - at)
    mark = tx.mix(np.arange(1, len(chunk) + 1, dtype=np.uint64))[doc[at]]
    _, first = np.unique(runs ^ mark, return_index=True)
    first = first[np.argsort(doc[at[first]], kind="stable")]
    return {
        "doc_id": chunk.batch.column(0),
        "row": chunk.batch.column(2),
        "hashes": tx.ragged(tx.signed(hashes), size),
        "words": tx.ragged(words.astype(np.int32), size),
        "runs": tx.ragged(tx.signed(runs[first]), np.bincount(doc[at[first]], minlength=len(chunk))),
    }


def _rising(b_of: list[int]) -> list[int]:
    """Places of a longest rising subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(b_of)
    for k, b in enumerate(b_of):
        at = bisect_left(tops, b)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal lines by patience diff, rising in both."""
    out, ranges = [], [(0, len(a), 0, len(b))]
    while ranges:
        i, m, j, n = ranges.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        seen: dict = {}
        for k in range(i, m):
            seen[a[k]] = -1 if a[k] in seen else k
        once: dict = {}
        for k in range(j, n):
            once[b[k]] = -1 if b[k] in once else k
        unique = [(k, once[x]) for x, k in seen.items() if k >= 0 and once.get(x, -1) >= 0]
        unique = [unique[k] for k in _rising([y for _, y in unique])]
        if unique:
            for x, y in unique:
                ranges.append((i, x, j, y))
                i, j = x, y
            ranges.append((i, m, j, n))
    return sorted(out)


def blocks_of(a: list, b: list, words: list[int]) -> list[int]:
    """Places in b of the lines in common blocks of BLOCK_WORDS words or more; what lies between them is aligned again."""
    gone, parts = [], [(0, len(b))]
    while parts:
        low, high = parts.pop()
        if sum(words[low:high]) < BLOCK_WORDS:
            continue
        found, run, last = [], [], (-2, -2)
        for x, y in [*aligned(a, b[low:high]), (-2, -2)]:
            if (x, y) != (last[0] + 1, last[1] + 1):
                if sum(words[low + k] for k in run) >= BLOCK_WORDS:
                    found.append((low + run[0], low + run[-1] + 1))
                run = []
            run.append(y)
            last = (x, y)
        if found:
            gone += [k for i, j in found for k in range(i, j)]
            parts += zip([low, *(j for _, j in found)], [*(i for i, _ in found), high], strict=True)
    return sorted(gone)


def _deleted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = []
        for a, b, words in zip(batch.column("first"), batch.column("hashes"), batch.column("words"), strict=True):
            gone.append(blocks_of(a.values.to_numpy().tolist(), b.values.to_numpy().tolist(), words.values.to_numpy().tolist()))
        found = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "gone": gone}, schema=GONE)
        yield found.filter(pa.array([bool(x) for x in gone]))


def _kept(chunk: tx.Chunk, with_text: bool) -> dict:
    starts, ends, doc = chunk.lines
    size = np.bincount(doc, minlength=len(chunk))
    first = np.cumsum(size) - size
    gone = [set(x or ()) for x in chunk.batch.column(2).to_pylist()]
    raw = chunk.buf.tobytes()
    texts = []
    for d, out in enumerate(gone):
        if out:
            spans = range(first[d], first[d] + size[d])
            texts.append(b"\n".join(raw[starts[k] : ends[k]] for i, k in enumerate(spans) if i not in out))
        else:
            texts.append(raw[chunk.offs[d] : chunk.offs[d + 1]])
    return {
        "doc_id": chunk.batch.column(0),
        "n_lines": size.astype(np.int64),
        "n_removed": np.array([len(x) for x in gone], np.int64),
        "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
    } | ({"text": [t.decode("utf-8", "replace") for t in texts]} if with_text else {})


def deletions(docs: DataFrame) -> DataFrame:
    """(doc_id, row, gone) of the documents that lose lines; docs has doc_id, text and row, a hash of the text."""
    lines = stored(tx.map_chunks(docs.filter("doc_id is not null"), _lines, LINES).dropDuplicates(["doc_id", "row"]))
    each = lines.select(F.struct("doc_id", "row").alias("here"), F.explode("runs").alias("run"))
    first = each.groupBy("run").agg(F.min("here").alias("first"), F.max("here.doc_id").alias("last"))
    first = stored(first.filter("first.doc_id < last").drop("last"))
    met = each.join(first, "run").filter("here.doc_id > first.doc_id").select("here", "first").distinct()
    pairs = stored(met.select("here.doc_id", "here.row", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row")))

    firsts = lines.select(F.col("doc_id").alias("first_id"), F.col("row").alias("first_row"), F.col("hashes").alias("first"))
    compared = pairs.join(lines.select("doc_id", "row", "hashes", "words"), ["doc_id", "row"]).join(firsts, ["first_id", "first_row"])
    gone = compared.select("doc_id", "row", "first", "hashes", "words").mapInArrow(_deleted, tx.ddl(GONE))
    return stored(gone.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))


def named_rows(docs: DataFrame) -> DataFrame:
    return tx.documents_of(docs).withColumn("row", F.xxhash64("text"))


def without_shared_lines(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Delete from each document the blocks of lines that it has in common with an earlier one.

    One row for each row: doc_id, n_lines (parts between newlines), n_removed,
    kept_sha256 of the lines left, joined by newlines, and with `with_text`
    these as text. Earlier means a smaller doc_id; each document is compared as
    it came, and with the first document of each of its runs of BLOCK_WORDS
    words. Rows that share a doc_id don't change each other; rows with a null doc_id take no part. A
    null text is one empty line. Columns other than doc_id and text are
    ignored; an empty table gives no rows.
    """
    docs = named_rows(docs)
    gone = deletions(docs)
    schema = RESULT_TEXT if with_text else RESULT
    return tx.map_chunks(docs.join(gone.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "gone"), lambda chunk: _kept(chunk, with_text), schema)


def _cut(text: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, places in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        if t is not None:
            drop = set(places or ())
            t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in drop)
        out.append(t)
    return pa.array(out, pa.string())


def with_lines_removed(docs: DataFrame) -> DataFrame:
    """The rows of docs with all columns they came with, less the deleted lines.

    A column n_chars follows the text. Rows that had words and are left without
    any go; all others stay, changed or not. Columns may have any names. For
    nulls and repeated rows see without_shared_lines.
    """
    here, key, lines, cut = (f"{name}_{uuid.uuid4().hex}" for name in ("here", "key", "lines", "cut"))
    gone = deletions(named_rows(docs)).select(F.struct("doc_id", "row").alias(key), F.col("gone").alias(lines)).hint("merge")
    named = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"))
    at = docs.withColumn(here, named).join(gone, F.col(here) == F.col(key), "left")
    # unchanged texts stay out of Python
    at = at.withColumn(cut, F.arrow_udf(_cut, "string")(F.when(F.col(lines).isNotNull(), F.col("text").cast("string")), lines))
    at = at.filter(F.col(cut).isNull() | F.col(cut).rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.coalesce(cut, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(cut).isNotNull(), F.length(cut)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return at.select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in docs.columns])
