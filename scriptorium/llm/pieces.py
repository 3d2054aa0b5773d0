"""Encoding texts as SentencePiece does, with every piece projected to the bytes it came from.

A text is normalised first: at each place the longest key of the model's
compiled character map that the text goes on with is replaced, and any other
character stays. Each byte that comes out records where in the source its key
or character begins. The normalised bytes are then merged into pieces by a copy
of the model that normalises nothing, so a piece is a run of normalised bytes
and its ends lead back to the source.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm import text as tx

MODEL = "piece_bpe_32k.model"
SPACE = "▁"

_MARK = np.frombuffer(SPACE.encode(), np.uint8)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin, laid end to end, and where the last ends."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[k], starts[k] + 1, ... of all runs."""
    at = starts_of(lengths)
    return np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)


class CharacterMap:
    """A compiled map: a double-array trie over UTF-8 keys, and the replacements that its leaves point to.

    The format: four bytes with the trie's size in bytes, its 32-bit units, then
    replacements that end in a zero byte. In a unit, bits 10 and up are the
    offset of the children (in steps of 256 if bit 9 is set), bit 8 says that
    the node ends a key, and the lowest 8 bits with bit 31 are its label.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.text = np.frombuffer(blob[4 + size :], np.uint8)
        ends = np.flatnonzero(self.text == 0)
        self.end_of = ends[np.searchsorted(ends, np.arange(len(self.text)))] if len(ends) else ends

    def _children(self, units: np.ndarray) -> np.ndarray:
        return (units >> 10) << ((units & 512) >> 6)

    def longest(self, buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, (length of the longest key in buf[at:end], where its replacement begins); length 0 for none."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        node = np.broadcast_to(self._children(self.units[:1]), len(at)).copy()
        depth = 0
        while len(live):
            inside = at[live] + depth < end[live]
            live, node = live[inside], node[inside]
            label = buf[at[live] + depth].astype(np.int64)
            node ^= label
            fits = node < len(self.units)
            unit = self.units[np.where(fits, node, 0)]
            fits &= (unit & 0x800000FF) == label
            live, node, unit = live[fits], node[fits], unit[fits]
            node ^= self._children(unit)
            depth += 1
            leaf = np.flatnonzero(unit & 256)
            length[live[leaf]] = depth
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value


class Normaliser:
    """Normalised bytes of texts, and for each the place in its text where what it stands for begins."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if len(spec.precompiled_charsmap) > 4 else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def _units(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is replaced or kept as one: where it begins, its length, where its output begins (-1: the unit itself), and the output's length."""
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        own = np.diff(at, append=len(buf))
        if self.map is None:
            return at, own, np.full(len(at), -1), own
        end = offs[1:][np.searchsorted(offs, at, "right") - 1]
        length, value = self.map.longest(buf, at, end)
        alive = np.ones(len(at), bool)
        # a key of several characters hides the places inside it
        for k in np.flatnonzero(length > own):
            if alive[k]:
                alive[k + 1 : np.searchsorted(at, at[k] + length[k])] = False
        at, own, length, value = at[alive], own[alive], length[alive], value[alive]
        hit = length > 0
        out = np.where(hit, value, -1)
        return at, np.where(hit, length, own), out, np.where(hit, self.map.end_of[value] - value, own)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, where each text's begin, source place of each byte and of each text's end), the last with one more for each text."""
        at, used, out, n = self._units(buf, offs)
        begins = runs(np.where(out < 0, at, out), n)
        made = np.repeat(out < 0, n)
        got = np.empty(len(begins), np.uint8)
        got[made] = buf[begins[made]]
        if not made.all():
            got[~made] = self.map.text[begins[~made]]
        source, stop = np.repeat(at, n), np.repeat(at + used, n)
        text = np.searchsorted(offs, source, "right") - 1
        space = got == 0x20
        if self.squeeze:
            first = np.ones(len(got), bool)
            first[1:] = text[1:] != text[:-1]
            before = np.concatenate([[False], space[:-1]]) | first
            keep = ~(space & before)
            got, source, stop, text, space = got[keep], source[keep], stop[keep], text[keep], space[keep]
        width = np.where(space & self.escape, 3, 1)
        flat = np.repeat(got, width)
        mark = np.repeat(space & self.escape, width)
        flat[mark] = np.tile(_MARK, int(mark.sum()) // 3)
        flat_source, flat_text, flat_stop = np.repeat(source, width), np.repeat(text, width), np.repeat(stop, width)
        begin = starts_of(np.bincount(flat_text, minlength=len(offs) - 1))
        last, some = begin[1:].copy(), np.diff(offs) > 0
        end = offs[1:].copy()
        if self.squeeze:
            whole, trail = flat.tobytes(), (SPACE if self.escape else " ").encode()
            filled = begin[:-1] < last
            end[filled] = flat_stop[last[filled] - 1]
            for k in np.flatnonzero(filled):
                while last[k] > begin[k] and whole[begin[k] : last[k]].endswith(trail):
                    last[k] -= len(trail)
                    end[k] = flat_source[last[k]]
            some = begin[:-1] < last
            end = np.where(some, end, offs[:-1])
        lead = (_MARK if self.escape else np.array([0x20], np.uint8)) if self.prefix else np.zeros(0, np.uint8)
        kept, led = last - begin[:-1], np.where(some, len(lead), 0)
        first = starts_of(kept + led)
        joined = np.empty(first[-1], np.uint8)
        place = np.empty(first[-1] + len(kept), np.int64)
        body, taken = runs(first[:-1] + led, kept), runs(begin[:-1], kept)
        shift = np.arange(len(kept))
        joined[body], place[body + np.repeat(shift, kept)] = flat[taken], flat_source[taken]
        ahead = runs(first[:-1], led)
        joined[ahead] = np.tile(lead, int(some.sum()))
        place[ahead + np.repeat(shift, led)] = np.repeat(flat_source[begin[:-1][some]], len(lead))
        place[first[1:] + shift] = end
        return joined, first, place


class Model:
    """A BPE model with byte fallback: ids of texts, and the normalised bytes of each id."""

    def __init__(self, model: str | bytes | None = None):
        import public_tokenizers
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if not isinstance(model, bytes):
            with open(model or public_tokenizers.path(MODEL), "rb") as file:
                model = file.read()
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = {p.type for p in proto.pieces}
        if not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix or proto.SentencePiece.USER_DEFINED in kinds:
            raise ValueError("a model with byte fallback, prefix spaces and no pieces of the user's own is needed")
        self.normalise = Normaliser(proto.normalizer_spec)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.normalizer_spec
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.encode() for p in proto.pieces]
        self.sizes = np.array([len(b) for b in self.bytes])
        self.decimals = list(map(str, range(len(self.bytes))))
        self.end = self.whole.eos_id()
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, raw: bytes, offs: np.ndarray) -> Encoded:
        """The texts raw[offs[k]:offs[k + 1]], each by itself."""
        joined, first, place = self.normalise(np.frombuffer(raw, np.uint8), offs)
        flat = joined.tobytes()
        found = self.plain.encode([flat[a:b].decode("utf-8", "replace") for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        at, end = starts_of(counts), starts_of(self.sizes[ids])
        if not np.array_equal(end[at], first):
            raise ValueError("pieces don't make up the normalised text")
        # place has one entry more for each text than there are bytes
        of = np.repeat(np.arange(len(found)), counts)
        return Encoded(found, ids, at, place[end[:-1] + of] - offs[of], place[end[1:] + of] - offs[of])


class Encoded(NamedTuple):
    """Texts as ids: a list for each, all in a row with where each text's begin, and the bytes of its text that each piece is of."""

    lists: list[list[int]]
    ids: np.ndarray
    first: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


@lru_cache(maxsize=1)
def model_of(model: str | bytes | None) -> Model:
    """Read once by a worker, for all its tasks."""
    return Model(model)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])


def _mapped(docs: DataFrame, model: str | bytes | None, fn, schema: pa.Schema) -> DataFrame:
    def run(batches):
        for chunk in tx.slices(batches):
            known = model_of(model)
            columns = fn(known, chunk, known.encode(chunk.buf.tobytes(), chunk.offs))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, [chunk.batch.column(0), *columns], strict=True)), schema=schema)

    return tx.documents_of(docs).mapInArrow(run, tx.ddl(schema))


def encoded(docs: DataFrame, model: str | bytes | None = None) -> DataFrame:
    """Each text as ids, without the end id, with the bytes [begins, ends) of the text that each piece stands for, and decoded again.

    A null or empty text has no ids. Of a character that falls back to bytes,
    the last byte's piece has the character and the others have its begin. The
    piece of a space that the model puts before a text is of no byte. A null
    doc_id stays null, rows that share one are documents of their own, other
    columns are ignored, and no rows give none. model: a path that all
    executors can read, or the model itself.
    """

    def fn(known: Model, chunk: tx.Chunk, got: Encoded) -> list:
        lists = [tx.ragged(x.astype(np.int32), np.diff(got.first)) for x in (got.ids, got.begins, got.ends)]
        return [*lists, list(map(known.whole.decode, got.lists))]

    return _mapped(docs, model, fn, ENCODED)


def digests(docs: DataFrame, model: str | bytes | None = None) -> DataFrame:
    """Each text as encoded(), with the end id, in one row of counts and digests.

    ids_sha256 is of the decimal ids with one space between them, decoded_sha256
    of the decoded text, spans_crc32 of the begins and ends as little-endian
    32-bit numbers in turn, without the end id. A null or empty text is the end
    id alone and decodes to the empty text.
    """

    def fn(known: Model, chunk: tx.Chunk, got: Encoded) -> list:
        ids, texts, crcs = [], [], []
        pairs = np.stack([got.begins, got.ends], 1).astype("<u4")
        for k, numbers in enumerate(got.lists):
            numbers.append(known.end)
            ids.append(hashlib.sha256(" ".join(map(known.decimals.__getitem__, numbers)).encode()).hexdigest())
            texts.append(hashlib.sha256(known.whole.decode(numbers).encode()).hexdigest())
            crcs.append(zlib.crc32(pairs[got.first[k] : got.first[k + 1]].tobytes()))
        return [np.diff(got.first) + 1, ids, texts, crcs]

    return _mapped(docs, model, fn, DIGESTS)
