"""Groups of tokens of two tokenizers that end at the same byte, and links between tokens that overlap.

Every byte of a text has a label: no token ends there, one of tokenizer A does,
one of B, or one of each. A regular expression takes the labels apart into
spans that reach up to each "both"; how often a label stands in a span says how
many tokens its group has. Between two labelled bytes one token of A meets one
of B, so each labelled byte is a link.

A is a byte-level BPE over a space and the text, B a SentencePiece BPE over the
text, before which it puts a space itself. Neither has a token that goes on
past the place before a space between two words: texts are cut there into
parts, the labels of parts that a worker hasn't met yet are made and scanned in
one string, and what they gave is kept for the texts to come.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import text as tx
from scriptorium.llm.pieces import SPACE, Model, model_of, runs, starts_of
from scriptorium.llm.store import forget, stored

VOCABULARY = "byte_bpe_50k.json"
#: Before such a space no token goes on: it stands between characters that are white space in no definition.
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
#: A part that may stand between two cuts, if it has no U+2581.
EDGES = re.compile(r"[!-~\w](?:.*[!-~\w])?\Z", re.DOTALL)
#: About so many characters of such parts are encoded as one text.
JOINED = 4000
#: A worker forgets the parts it knows when they are so many, or so many characters.
MOST_PARTS, MOST_CHARACTERS = 1 << 18, 1 << 24
#: Longer parts than this go to the tokenizers library, not to the rank file's.
LONG_PART = 10_000
#: The most pairs of ids that are broadcast with their counts, 17 bytes each.
HEAD = 1 << 20

#: Labels: 0 no end, 1 an end of A, 2 one of B, 3 both.
_SPAN = re.compile(rb"[\x00-\x02]*\x03")


def _byte_of() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones are themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A. The rank file beside the vocabulary, if there is one, gives the same ids in a quarter of the time."""

    def __init__(self, vocabulary: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary or public_tokenizers.path(VOCABULARY)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        byte_of = _byte_of()
        entries = sorted((i, token) for token, i in self.slow.get_vocab().items())
        self.bytes = [b""] * (entries[-1][0] + 1)
        for i, token in entries:
            self.bytes[i] = bytes(map(byte_of.__getitem__, token))
        self.sizes = np.array(list(map(len, self.bytes)))
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        fast = [self.fast is not None and len(t) <= LONG_PART for t in texts]
        rest = iter(self.slow.encode_batch([t for t, f in zip(texts, fast, strict=True) if not f], add_special_tokens=False)) if not all(fast) else iter(())
        return [self.fast.encode_ordinary(t) if f else next(rest).ids for t, f in zip(texts, fast, strict=True)]


class Parts:
    """What is known of the parts that a worker has met: numbers and links of each, and if asked for its groups as text."""

    def __init__(self, a: ByteLevel, b: Model, named: bool = True):
        self.a, self.b, self.named = a, b, named
        self.cuts = b.normalise.map is None and b.normalise.prefix and b.normalise.escape and not b.normalise.squeeze and not any(re.search(f"[^{SPACE}]{SPACE}", p.decode("utf-8", "replace")) for p in b.bytes)
        self.base = len(b.bytes)
        self.spelled = [p.replace(SPACE.encode(), b" ") for p in b.bytes]
        self.sizes_b = np.array(list(map(len, self.spelled)))
        self.written = [f"{i}{end}" for i in range(len(a.bytes)) for end in ",|"] + [f"{i}{end}" for i in range(self.base) for end in ",;\n"]
        self.generation = 0
        self.forget()

    def forget(self) -> None:
        self.generation += 1
        self.known: dict[str, int] = {}
        self.characters = 0
        #: For each part: whether its tokens' bytes are its own, and how many tokens of A and B and groups it has.
        self.whole, self.counts = np.zeros(0, bool), np.zeros((0, 3), np.int64)
        self.groups: list[str] = []
        #: The pairs of ids of all links, as a * base + b, and where each part's begin.
        self.pairs, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all parts in order, where each text's begin)."""
        cut = [CUT.split(t) if self.cuts else [t] for t in texts]
        flat = list(chain.from_iterable(cut))
        if len(self.known) >= MOST_PARTS or self.characters >= MOST_CHARACTERS:
            self.forget()
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            strange = [flat[k] for k in missing.tolist()]
            new = self.learn(list(dict.fromkeys(strange)))
            self.characters += sum(map(len, new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            at[missing] = np.fromiter(map(self.known.__getitem__, strange), np.int64, len(strange))
        return at, starts_of(np.fromiter(map(len, cut), np.int64, len(cut)))

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bytes]]:
        """Ids of A and of B, and the bytes of a space and each text."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        if self.cuts:
            # such a model normalises nothing but spaces
            ids_b = self.b.plain.encode([SPACE + t.replace(" ", SPACE) if t else "" for t in texts], num_threads=1)
        else:
            ids_b = self.b.encode(b"".join(raw), starts_of(np.fromiter(map(len, raw), np.int64, len(raw)))).lists
        return self.a.encode([" " + t for t in texts]), ids_b, [b" " + r for r in raw]

    def same(self, ids_a: list[list[int]], ids_b: list[list[int]], spaced: list[bytes]) -> np.ndarray:
        """Whether the joined bytes of both are those of each text."""
        return np.array([len(want) > 1 and b"".join([self.a.bytes[i] for i in x]) == want == b"".join([self.spelled[i] for i in y]) for x, y, want in zip(ids_a, ids_b, spaced, strict=True)], bool)

    def learn(self, new: list[str]) -> list[str]:
        """Keep what is to be known of new parts; they are returned in the order that they are numbered in.

        Parts that may stand between two cuts are encoded many at a time, as one text.
        """
        fit = [self.cuts and EDGES.match(p) is not None and SPACE not in p for p in new]
        easy, hard = list(compress(new, fit)), [p for p, f in zip(new, fit, strict=True) if not f]
        at = np.cumsum(np.fromiter(map(len, easy), np.int64, len(easy))) // JOINED
        cut = [*np.flatnonzero(np.diff(at, prepend=-1)).tolist(), len(easy)]
        joined = [" ".join(easy[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        ids_a, ids_b, spaced = self.tokens(joined)
        if not self.same(ids_a, ids_b, spaced).all():
            easy, hard, ids_a, ids_b = [], new, [], []
        more_a, more_b, alone = self.tokens(hard)
        whole = self.same(more_a, more_b, alone)
        ids_a, ids_b = (ids + [x if w else [] for x, w in zip(more, whole.tolist(), strict=True)] for ids, more in ((ids_a, more_a), (ids_b, more_b)))
        new, whole = easy + hard, np.concatenate([np.ones(len(easy), bool), whole])
        size = np.where(whole, np.fromiter((len(p.encode("utf-8", "replace")) for p in new), np.int64, len(new)) + 1, 0)
        part_end = np.cumsum(size)
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        labels = np.zeros(int(size.sum()), np.uint8)
        labels[np.cumsum(self.a.sizes[flat_a]) - 1] = 1
        labels[np.cumsum(self.sizes_b[flat_b]) - 1] += 2
        # links: the token of A or B at a labelled byte is the one after those that ended before
        at = np.flatnonzero(labels)
        ends_a, ends_b = (labels & 1)[at].astype(np.int64), (labels >> 1)[at].astype(np.int64)
        upto_a, upto_b = np.cumsum(ends_a), np.cumsum(ends_b)
        pairs = flat_a[upto_a - ends_a] * self.base + flat_b[upto_b - ends_b]
        last = np.searchsorted(at, part_end)
        # groups: spans of the labels of all parts, none of which goes on past its part; their counts of labels are their tokens
        n_spans = np.cumsum(np.fromiter(map(len, _SPAN.findall(labels.tobytes())), np.int64))
        here = np.searchsorted(at, n_spans)
        n_groups = np.searchsorted(n_spans, part_end, "right")
        if self.named:
            self.groups += self.names(flat_a, flat_b, upto_a[here - 1], upto_b[here - 1], n_groups)
        self.whole = np.concatenate([self.whole, whole])
        token_ends = (np.concatenate([[0], upto])[last] for upto in (upto_a, upto_b))
        self.counts = np.concatenate([self.counts, np.stack([np.diff(x, prepend=0) for x in (*token_ends, n_groups)], 1)])
        self.first = np.concatenate([self.first, self.first[-1] + last])
        self.pairs = np.concatenate([self.pairs, pairs])
        return new

    def names(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """Each part's groups as text, from the tokens up to each group's end and the groups up to each part's end.

        Each token is written with what follows it: a comma, a bar after the last of A in a group, a semicolon after the last of B, a new line after that of a part.
        """
        code_a, code_b = a * 2, b * 3
        code_a[upto_a - 1] += 1
        code_b[upto_b - 1] += 1
        some = np.unique(n_groups[n_groups > 0])
        code_b[upto_b[some - 1] - 1] += 1
        of_a, of_b = (np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0)) for upto in (upto_a, upto_b))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], upto_b])[of_a]] = code_a
        codes[np.arange(len(b)) + upto_a[of_b]] = code_b + 2 * len(self.a.bytes)
        lines = iter("".join(map(self.written.__getitem__, codes.tolist())).split("\n"))
        return [next(lines) if n else "" for n in np.diff(n_groups, prepend=0).tolist()]

    def texts(self, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parts, where each text's begin, whether a text has tokens): none have the empty text and those with a part that isn't whole."""
        parts, first = self.of(chunk.texts())
        return parts, first, np.minimum.reduceat(self.whole[parts], first[:-1]) if len(parts) else np.zeros(0, bool)


@lru_cache(maxsize=1)
def byte_level(vocabulary: str | None) -> ByteLevel:
    """Read once by a worker, for all its tasks."""
    return ByteLevel(vocabulary)


@lru_cache(maxsize=1)
def parts_of(vocabulary: str | None, model: str | bytes | None, named: bool = True) -> Parts:
    """Kept by a worker for all its tasks."""
    return Parts(byte_level(vocabulary), model_of(model), named)


def _summed(of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the entries of each text."""
    total = np.concatenate([[0], np.cumsum(of)])
    return total[first[1:]] - total[first[:-1]]


PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
GROUPS = pa.schema([("doc_id", pa.int64()), ("group_no", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64()))])
ALIGNED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("rest", pa.list_(pa.int64()))])


def link_counts(docs: DataFrame, vocabulary: str | None = None, model: str | bytes | None = None) -> DataFrame:
    """(pair, n): how many links of all texts hold an id a of A and b of B, where pair is a * (size of B) + b."""

    def run(batches):
        parts = parts_of(vocabulary, model, named=False)
        seen, generation = np.zeros(0, np.int64), parts.generation

        def counted() -> pa.RecordBatch:
            some = np.flatnonzero(seen)
            sizes = parts.first[some + 1] - parts.first[some]
            pairs, at = np.unique(parts.pairs[runs(parts.first[some], sizes)], return_inverse=True)
            n = np.bincount(at, np.repeat(seen[some], sizes), len(pairs)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], schema=PAIRS)

        for chunk in tx.slices(batches):
            if len(parts.known) >= MOST_PARTS or parts.characters >= MOST_CHARACTERS:
                yield counted()
                parts.forget()
            if generation != parts.generation:
                seen, generation = np.zeros(0, np.int64), parts.generation
            at, first, whole = parts.texts(chunk)
            now = np.bincount(at[np.repeat(whole, np.diff(first))], minlength=len(parts.known))
            now[: len(seen)] += seen
            seen = now
        yield counted()

    return tx.documents_of(docs).mapInArrow(run, tx.ddl(PAIRS)).groupBy("pair").agg(F.sum("n").alias("n"))


def token_groups(docs: DataFrame, vocabulary: str | None = None, model: str | bytes | None = None) -> DataFrame:
    """One row for each group: its bytes [begin, end) of a space and the text, and the ids of both tokenizers in it."""

    def run(batches):
        parts = parts_of(vocabulary, model)
        for chunk in tx.slices(batches):
            ids, texts = chunk.batch.column(0).to_pylist(), chunk.texts()
            at, first, whole = parts.texts(chunk)
            rows = []
            for k in np.flatnonzero(whole).tolist():
                place = 0
                for no, group in enumerate(";".join([parts.groups[p] for p in at[first[k] : first[k + 1]].tolist()]).split(";")):
                    a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                    end = place + int(parts.a.sizes[a].sum())
                    rows.append((ids[k], no, place, end, a, b))
                    place = end
                if place != len(texts[k].encode("utf-8", "replace")) + 1:
                    raise ValueError("groups don't make up the text")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), GROUPS, strict=True)], schema=GROUPS)

    return tx.documents_of(docs).mapInArrow(run, tx.ddl(GROUPS))


def _head(known: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The most frequent pairs, at most so many, as sorted (pairs, counts, whether best), and whether these are all."""
    class_of = F.floor(F.log2("n") * 16)
    sizes = dict(known.groupBy(class_of.alias("c")).count().collect())
    least, total = 0, 0
    for c in sorted(sizes, reverse=True):
        if total + sizes[c] > most:
            least = c + 1
            break
        total += sizes[c]
    got = known.filter(class_of >= least).select("pair", "n", "best").toArrow()
    pair, n, best = (got.column(k).to_numpy() for k in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order], least == 0


def aligned(docs: DataFrame, vocabulary: str | None = None, model: str | bytes | None = None, head: int = HEAD) -> DataFrame:
    """One row for each text with its tokens, groups and links, and how its links do over all texts.

    n_a, n_b, n_groups, n_links; n_best are the links whose pair of ids is as
    frequent as any with the same id of B, count_sum is the sum of the counts
    of the pairs of all its links, and groups_sha256 the digest of its groups as
    `a1,a2|b1;a3|b2,b3` in decimal ids. Null and empty texts and those that
    either tokenizer doesn't give back byte by byte have no tokens: zeros, and
    an empty groups_sha256. A null doc_id stays null, rows that share one are
    texts of their own, other columns are ignored, and no rows give none.

    Counts of pairs are a table; the most frequent, at most `head`, are
    broadcast, and the links of all others meet it in a join.
    """
    spark = docs.sparkSession
    size = len(model_of(model).bytes)
    counts = stored(link_counts(docs, vocabulary, model).withColumn("b", F.col("pair") % size))
    # one row for each id of B: no more than its vocabulary
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    known = stored(counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    forget(counts)
    *tables, complete = _head(known, head)
    shared = spark.sparkContext.broadcast(tables)

    def run(batches):
        parts, (pair, n, best) = parts_of(vocabulary, model), shared.value
        done, generation = 0, -1
        for chunk in tx.slices(batches):
            at, first, whole = parts.texts(chunk)
            if generation != parts.generation:
                done, generation = 0, parts.generation
                n_best = sums = np.zeros(0, np.int64)
                unknown = np.zeros(0, bool)
            # the parts that are new since the last chunk
            keys, upto = parts.pairs[parts.first[done] :], parts.first[done:] - parts.first[done]
            place = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
            hit = pair[place] == keys if len(pair) else np.zeros(len(keys), bool)
            n_best = np.concatenate([n_best, _summed(np.where(hit, best[place], False) if len(pair) else hit, upto)])
            sums = np.concatenate([sums, _summed(np.where(hit, n[place], 0) if len(pair) else hit.astype(np.int64), upto)])
            unknown = np.concatenate([unknown, ~hit])
            done = len(parts.first) - 1
            rest = []
            if not unknown.any():
                rest = [None] * len(chunk)
            else:
                for k, w in enumerate(whole.tolist()):
                    mine = at[first[k] : first[k + 1]] if w else at[:0]
                    links = runs(parts.first[mine], parts.first[mine + 1] - parts.first[mine])
                    rest.append(parts.pairs[links[unknown[links]]] if len(links) else None)
            zero = np.repeat(whole, np.diff(first))
            columns = [_summed(x[at] * zero, first) for x in (*parts.counts.T, np.diff(parts.first), n_best, sums)]
            digests = [hashlib.sha256(";".join([parts.groups[p] for p in at[first[k] : first[k + 1]].tolist()]).encode()).hexdigest() if w else "" for k, w in enumerate(whole.tolist())]
            yield pa.RecordBatch.from_pydict(dict(zip(ALIGNED.names, [chunk.batch.column(0), *columns, digests, rest], strict=True)), schema=ALIGNED)

    rows = tx.documents_of(docs).mapInArrow(run, tx.ddl(ALIGNED))
    names = [c for c in ALIGNED.names if c != "rest"]
    if complete:
        forget(known)
        return rows.select(names)
    return _with_rest(rows, known, names)


def _with_rest(rows: DataFrame, known: DataFrame, names: list[str]) -> DataFrame:
    """rows with the links of the pairs that were not broadcast."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    links = rows.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    more = links.join(known, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    joined = rows.select("row", *names).join(more, "row", "left")
    return joined.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(names)
