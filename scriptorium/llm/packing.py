"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full sequences and a rest. Rests of a task are
gathered into blocks worth `windows` sequences less a small allowance, and the
largest differencing method divides each block into near-equal windows: every
piece starts as a partition with one loaded window, and the two partitions
with the largest imbalance are merged again and again, heaviest windows upon
lightest. If the fullest window is beyond the capacity the number of windows
rises by one and the block is divided anew.

Each task packs its own rows, so nothing is shuffled and a task that is run
again gives the same sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import text as tx

CAPACITY = 2048
END_ID = 1
#: Sequences in a block, tokens a window that are left free for the differencing, and the largest piece of a rest.
WINDOWS, SLACK, PIECE = 256, 6, 512

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_WITH_IDS = PIECES.append(pa.field("ids", pa.list_(pa.int32())))


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by largest differencing: near-equal sums, ties by position."""
    heap = []
    sums_of, parts_of = [], []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(windows, np.int64)
        sums[-1] = size
        heap.append((-size, i))
        sums_of.append(sums)
        parts_of.append({windows - 1: [i]})
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        # sums are ascending: the heaviest of one meets the lightest of the other
        joined = sums_of[a] + sums_of[b][::-1]
        order = np.argsort(joined, kind="stable")
        place = np.empty(windows, np.int64)
        place[order] = np.arange(windows)
        parts: dict[int, list[int]] = {}
        for k, members in parts_of[a].items():
            parts[int(place[k])] = members
        for k, members in parts_of[b].items():
            parts.setdefault(int(place[windows - 1 - k]), []).extend(members)
        joined = joined[order]
        sums_of[a], parts_of[a] = joined - joined[0], parts
        sums_of[b] = parts_of[b] = None
        heapq.heappush(heap, (-int(sums_of[a][-1]), a))
    out = np.zeros(len(sizes), np.int64)
    if heap:
        for k, members in parts_of[heap[0][1]].items():
            out[members] = k
    return out


def windows_of(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A window for each size such that no window exceeds the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, windows)
        if np.bincount(at, sizes, windows).max() <= capacity:
            return at
        windows += 1


class Encoder:
    """Ids of byte_bpe_50k, followed by the end id.

    The vocabulary's rank file gives the ids that its tokenizers file gives, in
    a quarter of the time. The tokenizers library takes over for texts that the
    fast encoder refuses.
    """

    def __init__(self, vocabulary: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        with open(self.path.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        self.plain = None

    def slow(self, text: str) -> list[int]:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return self.plain.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        try:
            ids = self.fast.encode(text, allowed_special="all")
        except BaseException as error:  # the native encoder panics on a few odd texts, and a panic isn't an Exception
            if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            ids = self.slow(text)
        out = np.empty(len(ids) + 1, np.uint32)
        out[:-1] = ids
        out[-1] = END_ID
        return out


class Packer:
    """Pieces in, windows out; keeps at most a block of rests."""

    def __init__(self, first_id: int, capacity: int, with_ids: bool):
        self.next_id, self.capacity, self.with_ids = first_id, capacity, with_ids
        self.goal = WINDOWS * (capacity - SLACK)
        self.rests: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def put(self, doc_id, ids: np.ndarray, start: int, end: int, sequence: int, offset: int) -> None:
        part = ids[start:end]
        row = (doc_id, start, end - start, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence, offset)
        self.rows.append(row + (part.astype(np.int32),) if self.with_ids else row)

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while len(ids) - at >= self.capacity:
            self.put(doc_id, ids, at, at + self.capacity, self.next_id, 0)
            self.next_id += 1
            at += self.capacity
        while at < len(ids):
            end = min(len(ids), at + PIECE, at + self.goal - self.held)
            self.rests.append((doc_id, ids, at, end))
            self.held += end - at
            at = end
            if self.held == self.goal:
                self.flush()

    def flush(self) -> None:
        if not self.rests:
            return
        sizes = np.array([end - start for _, _, start, end in self.rests])
        windows, ids, fill = windows_of(sizes, self.capacity), {}, {}
        for (doc_id, tokens, start, end), window in zip(self.rests, windows.tolist(), strict=True):
            if window not in ids:
                ids[window], self.next_id = self.next_id, self.next_id + 1
            self.put(doc_id, tokens, start, end, ids[window], fill.get(window, 0))
            fill[window] = fill.get(window, 0) + end - start
        self.rests, self.held = [], 0

    def taken(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` ids; one row for each piece.

    A null or empty text is the end id alone. A null doc_id stays null, and rows
    that share a doc_id are packed as documents of their own. No rows give no
    pieces. Columns other than doc_id and text are ignored. A piece lies in
    one sequence; sequence ids are unique, not dense: the task's number times
    2**33 and a count. `with_ids` adds the ids themselves.
    """
    schema = PIECES_WITH_IDS if with_ids else PIECES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(vocabulary), Packer(TaskContext.get().partitionId() << 33, capacity, with_ids)
        for chunk in tx.slices(batches):
            for doc_id, text in zip(chunk.batch.column(0).to_pylist(), chunk.texts(), strict=True):
                packer.add(doc_id, encode(text))
                if len(packer.rows) >= 4096:
                    yield packer.taken(schema)
        packer.flush()
        if packer.rows:
            yield packer.taken(schema)

    return tx.documents_of(docs).mapInArrow(run, tx.ddl(schema))


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and the share of padding when each sequence short of a power of two is padded."""
    fill = pieces.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    cost = F.when(F.pow(2, F.floor(F.log2("fill"))) == F.col("fill"), F.col("fill")).otherwise(capacity)
    return fill.agg(F.count("*").alias("n_sequences"), F.sum("fill").alias("n_tokens"), (1 - F.sum("fill") / F.sum(cost)).alias("padding"))
