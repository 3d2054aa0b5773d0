"""Removal of long repeated passages by recompression.

Every text is rewritten in rounds, which all texts run alike and at once: runs of one token become one symbol, then
each round splits the alphabet in two by a bit of a symbol's hash and replaces
the pairs (left, right). A new symbol's name is a hash of what it stands for,
so all executors name equal runs and pairs alike without exchanging tables,
and equal passages get equal symbols in their interior. For each symbol the
range of tokens that decides upon it is carried along exactly; a symbol whose
range lies in a window is the same wherever this window stands.

Each window of `WINDOW` words is filed under one symbol: among the symbols it
decides, those of the highest round, the one with the least hash. Consecutive
windows under one symbol form a stretch. Spark groups stretches by symbol.
Symbols of a single document end there; for the others equal stretches are
settled at once, and only where a symbol stands in different stretches are
the windows compared one by one. The results are those of comparing all
windows of all documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import text as tx
from scriptorium.llm.store import forget, stored

WINDOW, ROUNDS = 50, 5

_U = np.uint64
_Q = _U(0xA0761D6478BD642F | 1)
_INDEX_BITS = _U(28)


class Level:
    """Symbols of one round: hashes, and the range of tokens [low, high) that decides upon each. Both ends ascend."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray):
        self.name, self.low, self.high, self.doc = name, low, high, doc


def rounds(h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> list[Level]:
    """Tokens, token runs, and ROUNDS rounds of pairs. first[d]:first[d + 1] are the tokens of document d."""
    n = len(h)
    at = np.arange(n)
    levels = [Level(h, at, at + 1, doc)]
    if not n:
        return levels
    head = np.ones(n, bool)
    head[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    beg = np.flatnonzero(head)
    length = np.diff(beg, append=n)
    # the tokens before and after a run decide that it ends there; beyond a document's ends no window reaches
    name = np.where(length > 1, tx.mix(h[beg] + length.astype(_U)), h[beg])
    levels.append(Level(name, beg - 1, beg + length + 1, doc[beg]))
    for r in range(ROUNDS):
        last = levels[-1]
        left = (tx.mix(last.name ^ _U(0x51ED2700 + r)) & _U(1)).astype(bool)
        same = last.doc[1:] == last.doc[:-1]
        pair = np.zeros(len(left), bool)
        pair[:-1] = left[:-1] & ~left[1:] & same
        taken = np.zeros(len(left), bool)
        taken[1:] = pair[:-1]
        name, low, high = last.name.copy(), last.low.copy(), last.high.copy()
        one = np.flatnonzero(pair)
        name[one] = tx.mix(last.name[one] * _Q + last.name[one + 1] + _U(r))
        high[one] = last.high[one + 1]
        # a single symbol is decided by the neighbour that it could have been paired with
        free = ~pair & ~taken
        right = np.flatnonzero(free & left)
        edge = (right == len(left) - 1) | ~np.append(same, False)[right]
        high[right] = np.where(edge, first[last.doc[right] + 1] + 1, last.high[np.minimum(right + 1, len(left) - 1)])
        back = np.flatnonzero(free & ~left)
        edge = (back == 0) | ~np.insert(same, 0, False)[back]
        low[back] = np.where(edge, first[last.doc[back]] - 1, last.low[np.maximum(back - 1, 0)])
        keep = ~taken
        levels.append(Level(name[keep], low[keep], high[keep], last.doc[keep]))
    return levels


class Filing:
    """Where the windows of a chunk are filed: runs of windows at[s]..at[e] under one symbol."""

    def __init__(self, chunk: tx.Chunk):
        words = chunk.words
        self.words, n = words, len(words)
        h = words.hashes
        inner = np.arange(max(0, n - WINDOW + 1))
        self.at = inner[words.doc[: len(inner)] == words.doc[len(inner) and WINDOW - 1 :][: len(inner)]]
        size = len(self.at)
        name, pick = np.zeros(size, _U), np.full(size, -1, np.int64)
        if size:
            open_ = np.arange(size)
            levels = rounds(h, words.doc, words.first)
            for depth in range(len(levels) - 1, -1, -1):
                level, p = levels[depth], self.at[open_]
                lo, hi = np.searchsorted(level.low, p), np.searchsorted(level.high, p + WINDOW, "right")
                some = lo < hi
                at = _least(level.name, lo[some], hi[some])
                here = open_[some]
                name[here], pick[here] = tx.mix(level.name[at] + _U(depth)), at * 16 + depth
                open_ = open_[~some]
                if not len(open_):
                    break
        new = np.ones(size, bool)
        new[1:] = (pick[1:] != pick[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        self.start = np.flatnonzero(new)
        self.size = np.diff(self.start, append=size)
        self.name = name[self.start]
        self.doc = words.doc[self.at[self.start]] if size else np.zeros(0, np.int64)
        # of any run of words
        self.hash = tx.Prefixes(h).hash

    @property
    def stretch(self) -> np.ndarray:
        return self.hash(self.at[self.start], self.size + WINDOW - 1) if len(self.start) else np.zeros(0, _U)

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into at, stretch) of the windows of some stretches."""
        n = self.size[of]
        index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[of], n)
        return index, np.repeat(of, n)


def _least(names: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range the index of the symbol with the least hash, the first of equals."""
    index = np.arange(len(names), dtype=_U)
    table = (tx.mix(names ^ _U(0x1F)) >> _INDEX_BITS << _INDEX_BITS) | index
    span, out = hi - lo, np.zeros(len(lo), _U)
    width = 1
    while len(lo):
        now = np.flatnonzero((span >= width) & (span < 2 * width))
        out[now] = np.minimum(table[lo[now]], table[hi[now] - width])
        if not np.any(span >= 2 * width):
            break
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return (out & ((_U(1) << _INDEX_BITS) - _U(1))).astype(np.int64)


STRETCHES = pa.schema([("symbol", pa.int64()), ("stretch", pa.int64()), ("doc_id", pa.int64())])
WINDOWS = pa.schema([("window", pa.int64()), ("check", pa.int32()), ("doc_id", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
RESULT_TEXT = RESULT.append(pa.field("text", pa.string()))


def _stretches(chunk: tx.Chunk) -> dict:
    filing = Filing(chunk)
    return {"symbol": tx.signed(filing.name), "stretch": tx.signed(filing.stretch), "doc_id": chunk.batch.column(0).take(pa.array(filing.doc))}


def _listed(chunk: tx.Chunk, column: str, mark: np.ndarray) -> np.ndarray:
    """The hashes that a list column has for each document, bound to the document and sorted."""
    lists = chunk.batch.column(chunk.batch.schema.get_field_index(column))
    counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
    return np.sort(values ^ np.repeat(mark, counts))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _windows(chunk: tx.Chunk) -> dict:
    """The windows of a document's unsettled stretches."""
    filing, mark = Filing(chunk), tx.mix(np.arange(1, len(chunk) + 1, dtype=_U))
    of = np.flatnonzero(_among(filing.stretch ^ mark[filing.doc], _listed(chunk, "unsettled", mark)))
    index, stretch = filing.windows(of)
    # equal windows have equal symbols too, which makes chance agreement of others about 2**-96 a pair
    check = (tx.mix(filing.name) >> _U(32)).astype(np.uint32).view(np.int32)
    return {"window": tx.signed(filing.hash(filing.at[index], WINDOW)), "check": check[stretch], "doc_id": chunk.batch.column(0).take(pa.array(filing.doc[stretch]))}


def _removed(chunk: tx.Chunk, with_text: bool) -> dict:
    filing, mark = Filing(chunk), tx.mix(np.arange(1, len(chunk) + 1, dtype=_U))
    words = filing.words
    drop = np.zeros(len(filing.at), bool)
    stretches, windows = _listed(chunk, "stretches", mark), _listed(chunk, "windows", mark)
    if len(stretches):
        drop[filing.windows(np.flatnonzero(_among(filing.stretch ^ mark[filing.doc], stretches)))[0]] = True
    if len(windows):
        some = np.flatnonzero(np.isin(words.doc[filing.at], np.flatnonzero(np.diff(np.searchsorted(np.sort(filing.doc), np.arange(len(chunk) + 1))))))
        some = some[~drop[some]]
        drop[some[_among(filing.hash(filing.at[some], WINDOW) ^ mark[words.doc[filing.at[some]]], windows)]] = True
    step = np.zeros(len(words) + 1, np.int64)
    step[filing.at[drop]] += 1
    step[filing.at[drop] + WINDOW] -= 1
    gone = np.cumsum(step[:-1]) > 0
    # kept words with the space byte that follows each
    take = words.inside.copy()
    take[words.inside] = np.repeat(~gone, words.ends - words.starts)
    follow = words.ends[~gone]
    doc_end = chunk.offs[1:][words.doc[~gone]]
    take[follow[follow < doc_end]] = True
    bytes_of = chunk.per_doc(take)
    out = np.where(tx.IS_SPACE[chunk.buf], np.uint8(32), chunk.buf)[take].tobytes()
    digests, texts, at = [], [], 0
    for n in bytes_of.tolist():
        kept = out[at : at + n]
        kept = kept[:-1] if kept.endswith(b" ") else kept
        digests.append(hashlib.sha256(kept).hexdigest())
        if with_text:
            texts.append(kept.decode("utf-8", "replace"))
        at += n
    return {
        "doc_id": chunk.batch.column(0),
        "n_words": words.counts.astype(np.int64),
        "n_removed": np.bincount(words.doc[gone], minlength=len(chunk)).astype(np.int64),
        "kept_sha256": digests,
    } | ({"text": texts} if with_text else {})


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of 50 words that also stands in a document with a smaller doc_id.

    One row for each row: doc_id, n_words, n_removed, kept_sha256 of the kept
    words joined by one space, and with `with_text` these words as text. A null
    text has no words. Rows that repeat a doc_id don't remove each other's
    words, and rows with a null doc_id take no part: they keep all words and
    remove none. Columns other than doc_id and text are ignored; an empty table
    gives no rows.
    """
    docs = tx.documents_of(docs)
    filed = stored(tx.map_chunks(docs.filter("doc_id is not null"), _stretches, STRETCHES))
    # written, so that the join reads both sides from exchanges whose large partitions can be split
    shared = stored(filed.groupBy("symbol").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("symbol"))
    met = stored(filed.join(shared, "symbol"))
    forget(filed)
    first = stored(met.groupBy("symbol", "stretch").agg(F.min("doc_id").alias("first")))
    several = stored(first.groupBy("symbol").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b")).filter("a < b").select("symbol"))
    removed = met.join(first, ["symbol", "stretch"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("stretch").alias("stretches"))

    unsettled = stored(first.join(several, "symbol").select(F.col("first").alias("doc_id"), "stretch"))
    unsettled = unsettled.groupBy("doc_id").agg(F.collect_set("stretch").alias("unsettled"))
    windows = stored(tx.map_chunks(docs.join(unsettled, "doc_id").select("doc_id", "text", "unsettled"), _windows, WINDOWS))
    earliest = stored(windows.groupBy("window", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("window", "check", "first"))
    later = windows.join(earliest, ["window", "check"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))

    found = stored(removed.join(later, "doc_id", "full"))
    schema = RESULT_TEXT if with_text else RESULT
    return tx.map_chunks(docs.join(found, "doc_id", "left").select("doc_id", "text", "stretches", "windows"), lambda chunk: _removed(chunk, with_text), schema)
