"""Benchmark decontamination by SimHash of item-sized windows.

Items fall into size classes. For each class a text is covered by windows of
that many words, closely spaced, and each window and item gets a 64-bit
SimHash of its words. The fingerprints are looked up by blocks: if two differ
in at most RADIUS bits, at least NEEDED of their eight blocks differ in no more
than NEAR bits. An index has, for each block and each of its values, the set of
the items that are so near, as bits; a window adds up the sets of its eight
values. Passages may be longer or shorter than the item, so each class has
windows a class shorter and longer too. Windows within the radius of an item
are verified exactly: of all runs of words in the neighbourhood, whatever their
length, the best weighted Jaccard similarity of 5-word shingles decides, and
what lies beside the best run is searched again.

Windows near no shingle of any item have similarity 0 and get no fingerprint.

The benchmark is the query set. It is brought to the driver in blocks of a
bounded number of items and bytes, and each block meets all documents in one
pass. How many items have a shingle is counted over the whole benchmark; only
shingles that more than one in SHARED items has are told apart by it, whose
number has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import text as tx

SHINGLE, SIMILARITY = 5, 0.75
#: Words and texts change little in a pair of this similarity; what the spacing of windows adds is small too.
RADIUS, BLOCKS, SPACING = 17, 8, 8
#: Blocks of fingerprints within the radius: were fewer than NEEDED as near as NEAR, the others would differ in more bits.
NEAR = RADIUS // BLOCKS
NEEDED = BLOCKS - RADIUS // (NEAR + 1)
#: Ratio of one size class to the next; items and bytes in a block; a shingle weighs no more than one that one in SHARED items has.
GROWTH, BLOCK_ITEMS, BLOCK_BYTES, SHARED = 1.2, 20_000, 16 << 20, 1000
#: Words whose running sums are held at once.
PIECE = 1 << 13

_U = np.uint64
LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
SHINGLES = pa.schema([("shingle", pa.int64())])


def _bits(h: np.ndarray) -> np.ndarray:
    """One row of 64 signs for each hash."""
    return (np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8) * 2 - 1).astype(np.int16)


def _running(signs: np.ndarray) -> np.ndarray:
    """Sums of the rows before each row and of all: within groups of 16 rows, then over the groups."""
    n = len(signs)
    out = np.zeros((n // 16 + 1, 16, 64), np.int32)
    out.reshape(-1, 64)[1 : n + 1] = signs[: n // 16 * 16 + 15]
    for k in range(1, 16):
        out[:, k] += out[:, k - 1]
    out[1:] += np.cumsum(out[:-1, 15], axis=0, dtype=np.int32)[:, None]
    return out.reshape(-1, 64)


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(_U).ravel()


def simhash(h: np.ndarray) -> np.uint64:
    return _fingerprint(_bits(h).astype(np.int64).sum(0)[None])[0]


def grams(h: np.ndarray) -> np.ndarray:
    """Shingle hashes in place; a shorter text is one shingle."""
    n = min(SHINGLE, len(h))
    return tx.gram_hashes(h, np.arange(len(h) - n + 1), n)


class SizeClass:
    """The items of about one size, and the index of their fingerprints."""

    def __init__(self, size: int, longest: int, items: list[int], prints: np.ndarray):
        self.size, self.longest, self.items, self.prints = size, longest, np.array(items), prints
        bytes_of = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BLOCKS)
        self.wide = -(-len(items) // 64)
        sets = np.zeros((BLOCKS, 256, self.wide * 8), np.uint8)
        for b in range(BLOCKS):
            near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ bytes_of[:, b]) <= NEAR
            sets[b, :, : -(-len(items) // 8)] = np.packbits(near, axis=1, bitorder="little")
        self.sets = sets.view(_U)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of the class) of all pairs within the radius."""
        out, step = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], max(1, (1 << 17) // self.wide)
        for low in range(0, len(prints), step):
            part = np.ascontiguousarray(prints[low : low + step])
            values = part.view(np.uint8).reshape(-1, BLOCKS)
            # how many of the blocks are near, for 64 items at a time: bit k of at_least[n] tells that n + 1 are
            at_least = [np.zeros((len(part), self.wide), _U) for _ in range(NEEDED)]
            for b in range(BLOCKS):
                more = self.sets[b][values[:, b]]
                for n in range(NEEDED - 1, 0, -1):
                    at_least[n] |= at_least[n - 1] & more
                at_least[0] |= more
            some = np.flatnonzero(at_least[-1].any(1))
            bits = np.unpackbits(at_least[-1][some].view(np.uint8), axis=1, bitorder="little")
            window, item = np.nonzero(bits)
            window = some[window]
            true = np.bitwise_count(part[window] ^ self.prints[item]) <= RADIUS
            out.append((window[true] + low, item[true]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Benchmark:
    """A block of items with words."""

    def __init__(self, rows: list[tuple[int, str]], n_items: int, shared: tuple[np.ndarray, np.ndarray]):
        chunk = next(tx.slices([pa.RecordBatch.from_pydict({"item_id": [r[0] for r in rows], "text": [r[1] for r in rows]})], 1 << 40)).lowered()
        words = chunk.words
        self.ids = [rows[k][0] for k in np.flatnonzero(words.counts)]
        self.words = [words.hashes[words.first[k] : words.first[k + 1]] for k in np.flatnonzero(words.counts)]
        self.shingles = [np.unique(grams(h)) for h in self.words]
        self.every = tx.Keys(np.unique(np.concatenate(self.shingles)))
        # a shingle of many items says little; one of no item weighs like one of a single item
        self.common, self.weights = tx.Keys(shared[0]), np.log1p(n_items / shared[1])
        self.other = float(np.log1p(min(n_items, SHARED)))
        self.weight_of = [float(self.weigh(s).sum()) for s in self.shingles]
        self.short = sorted({len(h) for h in self.words if len(h) < SHINGLE})
        by_size: dict[int, list[int]] = {}
        for k, h in enumerate(self.words):
            by_size.setdefault(round(np.log(len(h)) / np.log(GROWTH)), []).append(k)
        self.classes = []
        for members in by_size.values():
            median = np.median([len(self.words[k]) for k in members])
            prints = np.array([simhash(self.words[k]) for k in members], _U)
            for size in sorted({max(1, round(median * by)) for by in (1 / GROWTH, 1, GROWTH)}):
                self.classes.append(SizeClass(size, max(len(self.words[k]) for k in members), members, prints))
        self.longest = max(c.size for c in self.classes)

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        at = self.common.find(shingles)
        return np.where(at >= 0, self.weights[at], self.other) if len(self.weights) else np.full(len(shingles), self.other)

    def passages(self, k: int, h: np.ndarray) -> list[tuple[float, int, int]]:
        """(similarity, first word, words) of the runs of h that are item k: the most similar, the first and shortest of equals, and then those beside it."""
        n = min(SHINGLE, len(self.words[k]))
        search = Search(self, k, n, tx.gram_hashes(h, np.arange(max(0, len(h) - n + 1)), n))
        if self.weigh(np.unique(search.text[search.inside])).sum() < search.least:
            return []
        starts = np.flatnonzero(search.inside)
        best = np.array([search.run_from(a, len(search.text)) for a in starts.tolist()])
        found, gaps = [], [(0, len(h))]
        while gaps:
            low, high = gaps.pop()
            mine = slice(*np.searchsorted(starts, [low, high]))
            for j in (np.flatnonzero(best[mine, 1] + n > high) + mine.start).tolist():
                best[j] = search.run_from(int(starts[j]), high - n + 1)
            if mine.start == mine.stop or best[mine, 0].max() < SIMILARITY:
                continue
            j = mine.start + int(np.argmax(best[mine, 0] > best[mine, 0].max() - 1e-12))
            a, end = int(starts[j]), int(best[j, 1]) + n
            found.append((float(best[j, 0]), a, end - a))
            gaps += [(low, a), (end, high)]
        return found


class Search:
    """Runs of a text's shingles against one item."""

    def __init__(self, bench: Benchmark, k: int, n: int, text: np.ndarray):
        self.text, self.inside, self.weight = text, np.isin(text, bench.shingles[k]), bench.weigh(text)
        self.whole, self.size = bench.weight_of[k], len(bench.words[k])
        self.least = SIMILARITY * self.whole - 1e-9
        # the place before at which each shingle stood last: it counts once in a run
        order = np.argsort(text, kind="stable")
        same = text[order[1:]] == text[order[:-1]]
        self.before = np.full(len(text), -1, np.int64)
        self.before[order[1:][same]] = order[:-1][same]

    def run_from(self, a: int, stop: int) -> tuple[float, int]:
        """The highest similarity of a run of shingles from a on that ends before stop, and its last shingle; 0 where none is similar.

        Looks no further than where the run has the whole item, or too much besides for any longer one.
        """
        length = 2 * self.size
        while True:
            end = min(stop, a + length)
            new = np.where(self.before[a:end] < a, self.weight[a:end], 0.0)
            both = np.cumsum(np.where(self.inside[a:end], new, 0.0))
            if not len(both):
                return 0.0, a
            union = self.whole + np.cumsum(new) - both
            if end == stop or both[-1] >= self.whole - 1e-9 or self.whole < SIMILARITY * union[-1]:
                break
            length *= 2
        similarity = both / union
        at = int(np.argmax(similarity > similarity.max() - 1e-12))
        return (float(similarity[at]), a + at) if both[-1] >= self.least and similarity[at] >= SIMILARITY else (0.0, a)


def leaks_of(chunk: tx.Chunk, bench: Benchmark) -> dict:
    words = chunk.lowered().words
    out: dict[str, list] = {name: [] for name in LEAKS.names}
    # where any item's shingle begins: elsewhere every similarity is 0
    begins = np.zeros(len(words), bool)
    for size in {SHINGLE, *bench.short}:
        keys, at = words.grams(size)
        begins[at[bench.every.find(keys) >= 0]] = True
    hit = np.unique(words.doc[begins])
    if len(hit):
        # from here on only the texts that have one
        mine = np.isin(words.doc, hit)
        h, counts = words.hashes[mine], words.counts[hit]
        first, known = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, begins[mine]))
        met = []
        for group in bench.classes:
            size = group.size
            step = max(1, size // SPACING)
            per_doc = 1 + -(-np.maximum(counts - size, 0) // step)
            doc = np.repeat(np.arange(len(hit)), per_doc)
            start = first[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc))
            end = np.minimum(start + size, first[doc + 1])
            low, high = np.maximum(start - step - group.longest, first[doc]), np.minimum(end + step + group.longest, first[doc + 1])
            some = known[high] > known[low]
            met.append((doc[some], start[some], end[some], low[some], high[some]))
        found, piece = [(np.zeros(0, np.int64),) * 4], max(PIECE, bench.longest)
        for at in range(0, len(h), piece):
            part = [slice(*np.searchsorted(start, [at, at + piece])) for _, start, *_ in met]
            if all(m.start == m.stop for m in part):
                continue
            total = _running(_bits(h[at : at + piece + bench.longest]))
            for group, m, (doc, start, end, low, high) in zip(bench.classes, part, met, strict=True):
                window, item = group.near(_fingerprint(total[end[m] - at] - total[start[m] - at]))
                window += m.start
                found.append((group.items[item], doc[window], low[window], high[window]))
        # windows of all classes together, so that a passage is found once
        for k, doc, at, size, similarity in _verified(bench, *(np.concatenate(x) for x in zip(*found, strict=True)), h):
            for name, value in zip(LEAKS.names, (int(hit[doc]), bench.ids[k], int(at - first[doc]), size, similarity), strict=True):
                out[name].append(value)
    found = pa.RecordBatch.from_pydict(out | {"doc_id": chunk.batch.column(0).take(pa.array(out["doc_id"], pa.int64()))}, schema=LEAKS)
    return {name: found.column(name) for name in LEAKS.names}


def _verified(bench: Benchmark, item: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
    """(item, document, first word, words, similarity). Windows of an item that overlap are one stretch; each stretch is searched once."""
    order = np.lexsort((low, doc, item))
    item, doc, low, high = (x[order].tolist() for x in (item, doc, low, high))
    k = 0
    while k < len(item):
        j, end = k, high[k]
        while j + 1 < len(item) and (item[j + 1], doc[j + 1]) == (item[k], doc[k]) and low[j + 1] <= end:
            j += 1
            end = max(end, high[j])
        for similarity, at, size in bench.passages(item[k], h[low[k] : end]):
            yield item[k], doc[k], low[k] + at, size, similarity
        k = j + 1


def _verify(bench: Benchmark, item: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, words: tx.Words, out: dict) -> None:
    """Windows of an item that overlap are one stretch; each stretch is searched once."""
    order = np.lexsort((low, doc, item))
    item, doc, low, high = (x[order].tolist() for x in (item, doc, low, high))
    k = 0
    while k < len(item):
        j, end = k, high[k]
        while j + 1 < len(item) and (item[j + 1], doc[j + 1]) == (item[k], doc[k]) and low[j + 1] <= end:
            j += 1
            end = max(end, high[j])
        for similarity, at, size in bench.passages(item[k], words.hashes[low[k] : end]):
            for name, value in zip(LEAKS.names, (doc[k], bench.ids[item[k]], int(low[k] + at - words.first[doc[k]]), size, similarity), strict=True):
                out[name].append(value)
        k = j + 1


def frequencies(benchmark: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """Items with words, and the shingles that more than one of them and more than one in SHARED has, with their numbers, sorted."""

    def shingles(chunk: tx.Chunk) -> dict:
        words = chunk.lowered().words
        each = [np.unique(grams(words.hashes[words.first[k] : words.first[k + 1]])) for k in np.flatnonzero(words.counts)]
        return {"shingle": tx.signed(np.concatenate(each)) if each else np.zeros(0, np.int64)}

    items = tx.documents_of(benchmark, "item_id").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n = items.count()
    got = tx.map_chunks(items, shingles, SHINGLES).groupBy("shingle").count().filter((F.col("count") > 1) & (F.col("count") * SHARED > n)).toArrow()
    keys = got["shingle"].to_numpy().view(_U)
    order = np.argsort(keys)
    return n, (keys[order], got["count"].to_numpy()[order])


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if len(block) == BLOCK_ITEMS or size > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += len(row[1])
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) for each passage of a document that is a benchmark item.

    Words are lower-cased in A-Z. A passage is the run of words that is most
    similar to the item, longer or shorter; start counts the document's words
    before it. Similarity is the
    weighted Jaccard similarity of the sets of 5-word shingles, at least 0.75;
    a shingle weighs log(1 + items / items that have it), but no more than one
    that one in SHARED has; one of no item weighs like one of a single item. Items of fewer words are one shingle; null, empty and
    blank items and texts match nothing. Separate passages of one item are rows
    of their own. Null doc_ids and repeated rows are reported as they are.
    Columns other than those named are ignored; an empty table gives no rows.
    """
    docs = tx.documents_of(docs)
    found = counts = None
    for rows in item_blocks(benchmark):
        if not any(text.strip(" \t\n\v\f\r") for _, text in rows):
            continue
        counts = counts or frequencies(benchmark)
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(rows, *counts))
        one = tx.map_chunks(docs, lambda chunk, shared=shared: leaks_of(chunk, shared.value), LEAKS)
        found = one if found is None else found.union(one)
    return docs.sparkSession.createDataFrame([], tx.ddl(LEAKS)) if found is None else found
