"""Documents as numpy arrays inside Spark tasks.

Text reaches the Python workers as Arrow string columns. Their UTF-8 bytes are
handled in place, a bounded slice at a time, so that memory doesn't depend on
how many rows Spark puts into a batch.

Words are maximal runs of bytes other than space and 0x09-0x0D, which for
UTF-8 is the same as the character rule. Words, lines and n-grams are named by
64-bit hashes that are the same on every executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20

_U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
_GRAM = _U(0xD6E8FEB86659FD93)
_RUN = _U(0xA0761D6478BD642F)
_RUN_BACK = _U(pow(int(_RUN), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: The longest span that is hashed by eights, and masks that keep the first bytes of eight.
SHORT = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_BYTE = mix(np.arange(1, 257, dtype=_U))
_powers = np.ones(1, _U)


def powers(n: int) -> np.ndarray:
    """The first n powers of the byte base, modulo 2**64; kept per worker."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(2 * n, _BASE, _U)]))
    return _powers


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]; the empty span hashes to mix(0).

    Short spans are taken eight bytes at a time, long ones byte by byte as a polynomial: a span's length decides.
    """
    lens = ends - starts
    out = np.zeros(len(lens), _U)
    long = np.flatnonzero(lens > SHORT)
    if len(long):
        n, s = lens[long], starts[long]
        at = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(at, n)
        part = _BYTE[buf[within + np.repeat(s, n)]]
        part *= powers(int(n.max()))[within]
        out[long] = np.add.reduceat(part, at) + n.astype(_U)
    short = np.flatnonzero((lens > 0) & (lens <= SHORT)) if len(long) or not lens.all() else np.arange(len(lens))
    if len(short):
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
        n, s = lens[short], starts[short]
        acc, live = n.astype(_U) * _BASE, np.arange(len(n))
        for k in range(0, int(n.max()), 8):
            live = live[n[live] > k] if k else live
            piece = eight[s[live] + k] & _FIRST_BYTES[np.minimum(n[live] - k, 8)]
            piece = (acc[live] ^ piece) * _GRAM
            acc[live] = piece ^ (piece >> _U(32))
        out[short] = acc
    return mix(out)


class Chunk:
    """Some whole documents: their bytes, and where each begins."""

    def __init__(self, batch: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray):
        self.batch, self.buf, self.offs = batch, buf, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def lowered(self) -> Chunk:
        return Chunk(self.batch, LOWER[self.buf], self.offs)

    def texts(self) -> list[str]:
        raw = self.buf.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.offs[:-1].tolist(), self.offs[1:].tolist(), strict=True)]

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """The sum of one number for each byte, by document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    @cached_property
    def words(self) -> Words:
        return Words(self)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document of the parts between newlines; an empty document has one."""
        cut = np.flatnonzero(self.buf == 10)
        starts = np.concatenate([self.offs[:-1], cut + 1])
        doc = np.concatenate([np.arange(len(self)), self.doc_of(cut)])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        last = np.flatnonzero(np.diff(doc, append=-1))
        ends[last] = self.offs[1:]
        return starts, ends, doc

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1


class Words:
    """The words of a chunk: byte spans, hashes, and the words of each document as first[d]:first[d + 1]."""

    def __init__(self, chunk: Chunk):
        self.buf = chunk.buf
        inside = ~IS_SPACE[chunk.buf]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = chunk.offs[(chunk.offs > 0) & (chunk.offs < n)]
        before[edge] = False
        after[edge - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, chunk.offs)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first words) of the runs of n words that lie in one document."""
        if len(self) < n:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: len(self) - n + 1] == self.doc[n - 1 :])
        return gram_hashes(self.hashes, at, n), at


def gram_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of h[i:i+n] for each i in at."""
    acc = np.zeros(len(at), _U)
    for k in range(n):
        acc *= _GRAM
        acc += h[at + k]
    return mix(acc + _U(n))


class Keys:
    """Distinct sorted keys, found by their first bits: as hashes they lie evenly."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, _U(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=_U))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1."""
        slot = (keys >> self.shift).astype(np.int64)
        out, at, end = np.full(len(keys), -1, np.int64), self.first[slot], self.first[slot + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            place = at[live]
            hit = self.keys[place] == keys[live]
            out[live[hit]] = place[hit]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


class Prefixes:
    """Hashes of any runs of a sequence of hashes, from sums over its prefixes modulo 2**64."""

    def __init__(self, h: np.ndarray):
        power, back = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(len(h), x, _U)])) for x in (_RUN, _RUN_BACK))
        self.undo = back
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * power[:-1], dtype=_U)])

    def hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        part = (self.sums[start + length] - self.sums[start]) * self.undo[start]
        return mix(part + np.asarray(length).astype(_U))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def slices(batches: Iterable[pa.RecordBatch], budget: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of at most budget bytes of text; a longer document is one by itself."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        text = batch.column(at)
        if text.null_count:
            text = pc.fill_null(text, "")
        wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
        if not len(text):
            continue
        _, offsets, data = text.buffers()
        offs = np.frombuffer(offsets, wide, len(text) + 1, text.offset * wide().itemsize).astype(np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + budget, "right")) - 1)
            yield Chunk(batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            lo = hi


_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.float32(): "float", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    def one(t: pa.DataType) -> str:
        return f"array<{one(t.value_type)}>" if pa.types.is_list(t) else _DDL[t]

    return ", ".join(f"`{f.name}` {one(f.type)}" for f in schema)


def map_chunks(df: DataFrame, fn: Callable[[Chunk], dict], schema: pa.Schema, budget: int = CHUNK_BYTES) -> DataFrame:
    """Apply fn to the rows of df, whose text column it gets as chunks; fn returns the columns of schema."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in slices(batches, budget):
            yield pa.RecordBatch.from_pydict(fn(chunk), schema=schema)

    return df.mapInArrow(run, ddl(schema))


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string) of a table; a null text is empty. All other columns are left behind.

    Arrow batches of the session are held to BATCH_BYTES, for memory.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ragged(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """One list for each length, cut from values in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))
