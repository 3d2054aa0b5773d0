"""Language-model scores by a weighted backoff automaton.

The model is a trigram model, smoothed by absolute discounts, over all words,
and all bigrams and trigrams that occur at least twice in the training texts,
at every size of the corpus. Its n-grams are states; a state has an arc for
each word that was kept after it, weighted by the word's probability, and one
failure arc, weighted by what the discounts set free, to the state of the next
shorter history. The root gives each word its add-one unigram probability. An
arc's probability has its share of the failure path, so all probabilities of a
history sum to 1.

The weight of a path from left to right is a sum over its n-grams: each has a
value, what it changes against the path without it, and the score of a text is
the sum of the values of all its words, bigrams and trigrams. So the automaton
stays a distributed table, and a text meets it by a join. Values of the most
frequent n-grams are broadcast, under the bound HEAD; all others have the join.

N-grams are named by 64-bit hashes. They travel as packed arrays, one row for
each bucket of keys and slice of text, since there is about one n-gram for each
word of the corpus. Buckets are as many as the corpus asks for, and each task
takes its buckets one by one.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import text as tx
from scriptorium.llm.store import forget, stored

#: Bound of the broadcast part: an n-gram is in it if it makes up 1/HEAD of the tokens.
HEAD = 4_000_000
#: Parts of the keys that are scored one after the other, a power of two, so that only a part is on disk at once.
ROUNDS = 2
DISCOUNT, LEAST = 0.5, 2
#: Text whose n-grams are counted together, and asked for together; bytes of text for each bucket; the least number of buckets.
GRAM_BYTES, ASK_BYTES, BUCKET_BYTES, BUCKETS = 4 << 20, 2 << 20, 10 << 20, 48
#: log2 of the bits of a filter of keys, whatever their number: with too many keys it lets more pass, never less.
FILTER_BITS = 27

_U = np.uint64
END = tx.mix(np.array([0xE07E5D], _U))[0]

PACKED = pa.schema([("size", pa.int32()), ("bucket", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary())])
GRAMS = pa.schema([("size", pa.int32()), ("key", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])
TABLE = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("value", pa.float64())])
ASKED = pa.schema([("bucket", pa.int32()), ("asks", pa.bool_()), ("keys", pa.binary()), ("n", pa.binary()), ("value", pa.binary()), ("at", pa.binary()), ("rows", pa.binary())])
SUMS = pa.schema([("row", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("value", pa.float64())])
SCORES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])


def tokens_of(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each document and an end, and the document of each."""
    words = chunk.lowered().words
    return np.insert(words.hashes, words.first[1:], END), np.insert(words.doc, words.first[1:], np.arange(len(chunk)))


def key_of(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The key of an n-gram, from the keys of it without its last and without its first word."""
    return tx.mix(tx.mix(left + _U(size)) + right)


def runs(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Keys of the runs of 1, 2, .. size tokens from each place on, across documents too. A word's key is its hash."""
    out = [hashes]
    for n in range(2, size + 1):
        out.append(key_of(out[-1][:-1], out[-1][1:], n))
    return out


def places(doc: np.ndarray, size: int) -> np.ndarray:
    """Where the runs of size tokens begin that lie in one document."""
    return np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :]) if len(doc) >= size else np.zeros(0, np.int64)


def held_out_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row, held_out); row names a row's contents, a null doc_id is crc32 of no bytes."""
    docs = tx.documents_of(docs)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), (crc % 7 == 2).alias("held_out"))


# --- filters of keys ---


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has a bit of each key(bigint)."""
    placed = keys.select((F.shiftrightunsigned("key", 64 - FILTER_BITS) + 1).alias("place"))
    parts = placed.groupBy(F.expr("bitmap_bucket_number(place)").alias("part"))
    got = parts.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) >> 3, np.uint8)
    for part, bits in zip(got["part"].to_pylist(), got["bits"].to_pylist(), strict=True):
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(bits, np.uint8)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> _U(64 - FILTER_BITS)
    return (bits[place >> _U(3)] >> (place & _U(7)).astype(np.uint8) & 1).astype(bool)


# --- counts ---


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the key."""
    return ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)


def cuts(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket_of(sorted_keys, buckets), np.arange(buckets + 1))


def by_bucket(df: DataFrame, buckets: int, *order: str) -> DataFrame:
    return df.repartition(buckets, *order[:1]).sortWithinPartitions(*order)


def numbers(packed: Iterable, dtype: type) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in packed]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def counted(train: DataFrame, sizes: tuple[int, ...], buckets: int, asked: Callable | None = None) -> DataFrame:
    """(size, key, left, right, n) of all words, and of the longer runs that occur LEAST times or more.

    left and right are the keys without the last and the first word, of a word
    itself and 0. `asked` returns a filter that left and right must pass.
    """

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.slices(batches, GRAM_BYTES):
            hashes, doc = tokens_of(chunk)
            all_keys = runs(hashes, max(sizes))
            for size in sizes:
                at = places(doc, size)
                parts_of = all_keys[size - 2] if size > 1 else hashes
                if asked is not None:
                    good = passes(asked(), parts_of)
                    at = at[good[at] & good[at + 1]]
                if not len(at):
                    continue
                keys = all_keys[size - 1][at]
                order = np.argsort(keys)
                new = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
                first, n = at[order[new]], np.diff(new, append=len(keys)).astype(np.int32)
                cut = cuts(keys[order[new]], buckets)
                full = np.flatnonzero(np.diff(cut)).tolist()
                columns = {"left": parts_of[first], "right": parts_of[first + 1] if size > 1 else np.zeros(len(first), _U), "n": n}
                packed = {name: [x[cut[b] : cut[b + 1]].tobytes() for b in full] for name, x in columns.items()}
                yield pa.RecordBatch.from_pydict({"size": [size] * len(full), "bucket": full} | packed, schema=PACKED)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["bucket"], r["size"], r) for batch in batches for r in batch.to_pylist())
        for (_, size), group in groupby(rows, key=lambda x: x[:2]):
            left, right, n = zip(*[(r["left"], r["right"], r["n"]) for _, _, r in group], strict=True)
            left, right, n = numbers(left, _U), numbers(right, _U), numbers(n, np.int32)
            keys = key_of(left, right, size) if size > 1 else left
            order = np.argsort(keys)
            new = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            n = np.add.reduceat(n[order].astype(np.int64), new)
            keep = np.flatnonzero(n >= (LEAST if size > 1 else 1))
            n, pick = n[keep], order[new[keep]]
            for lo in range(0, len(pick), 100_000):
                part = pick[lo : lo + 100_000]
                yield pa.RecordBatch.from_pydict({"size": np.full(len(part), size, np.int32), "key": tx.signed(keys[part]), "left": tx.signed(left[part]), "right": tx.signed(right[part]), "n": n[lo : lo + 100_000]}, schema=GRAMS)

    rows = train.mapInArrow(dealt, tx.ddl(PACKED))
    return stored(by_bucket(rows, buckets, "bucket", "size").mapInArrow(summed, tx.ddl(GRAMS)))


def _free(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of what is done."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


# --- the automaton ---


def automaton(train: DataFrame, buckets: int) -> tuple[int, int, DataFrame]:
    """(tokens, distinct tokens, (key, n, value) of all words and of the kept n-grams); n is 0 but for words.

    Large partitions of the joins, those of frequent histories, are split at run time.
    """
    short = counted(train, (1, 2), buckets)
    singles, pairs = short.filter("size = 1").select("key", "n"), short.filter("size = 2").select("key", "left", "right", "n")
    n, v = singles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    _free(train)
    among = train.sparkSession.sparkContext.broadcast(key_filter(pairs.select("key")))
    triples = counted(train, (3,), buckets, lambda: among.value)
    _free(train)

    # what the discounts of a history's arcs set free is what the arcs don't have
    taken = lambda arcs: arcs.groupBy(F.col("left").alias("key")).agg(F.sum(F.col("n") - DISCOUNT).alias("taken"))
    free = 1 - F.coalesce(F.col("taken"), F.lit(0.0)) / F.col("n")
    root = lambda c: (F.col(c) + 1.0) / float(n + v + 1)
    words = stored(singles.join(taken(pairs), "key", "left").select("key", "n", free.alias("free")))
    history = lambda of: of.select(F.col("key").alias("left"), F.col("n").alias("c"), F.col("free").alias("spare"))
    arc = lambda: (F.col("n") - DISCOUNT) / F.col("c") + F.col("spare") * F.col("low")
    gain = F.log10("p") - F.log10(F.col("spare") * F.col("low"))

    pairs = pairs.join(history(words), "left").join(words.select(F.col("key").alias("right"), root("n").alias("low")), "right")
    pairs = pairs.withColumn("p", arc()).select("key", "n", "p", gain.alias("gain"))
    pairs = stored(pairs.join(taken(triples), "key", "left").select("key", "n", "p", "gain", free.alias("free")))
    forget(short)
    _free(train)
    longer = triples.join(history(pairs), "left").join(pairs.select(F.col("key").alias("right"), F.col("p").alias("low")), "right").withColumn("p", arc())
    longer = stored(longer.select("key", gain.alias("value"), "n"))
    forget(triples)
    _free(train)
    # all n-grams of a text but those that end it are followed by a token, which pays for the failure arc first
    table = words.select("key", "n", (F.log10(F.col("n") + 1.0) + F.log10("free")).alias("value"), F.col("n").alias("weight"))
    table = table.union(pairs.select("key", F.lit(0), F.col("gain") + F.log10("free"), "n"))
    table = stored(table.union(longer.select("key", F.lit(0), "value", "n")))
    for done in (words, pairs, longer):
        forget(done)
    _free(train)
    return n, v, table


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the values that rows ask for; within a bucket the table comes first."""
    rows = ((r["bucket"], r["asks"], r) for batch in batches for r in batch.to_pylist())
    table, asking = (tx.Keys(np.zeros(0, _U)), np.zeros(0), np.zeros(0)), None
    for (bucket, asks), group in groupby(rows, key=lambda x: x[:2]):
        if not asks:
            packed = [r for _, _, r in group]
            columns = [numbers([r[name] for r in packed], dtype) for name, dtype in (("keys", _U), ("n", np.int64), ("value", np.float64))]
            order = np.argsort(columns[0])
            table, asking = (tx.Keys(columns[0][order]), columns[1][order], columns[2][order]), bucket
            continue
        if asking != bucket:
            continue
        for _, _, r in group:
            place = table[0].find(np.frombuffer(r["keys"], _U))
            hit = np.flatnonzero(place >= 0)
            at, ids, place = np.frombuffer(r["at"], np.int32)[hit], np.frombuffer(r["rows"], np.int64), place[hit]
            n, value = table[1][place], table[2][place]
            some = np.flatnonzero(np.bincount(at, minlength=len(ids)))
            sums = [np.bincount(at, x, len(ids))[some] for x in (n > 0, np.log10(n + 1.0), value)]
            yield pa.RecordBatch.from_pydict({"row": ids[some], "known": sums[0].astype(np.int64), "base": sums[1], "value": sums[2]}, schema=SUMS)


def _packed_table(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_numpy().view(_U)
        order = np.argsort(keys)
        cut = cuts(keys[order], buckets)
        full = np.flatnonzero(np.diff(cut)).tolist()
        columns = [x[order] for x in (keys, batch.column("n").to_numpy(), batch.column("value").to_numpy())]
        parts = {name: [x[cut[b] : cut[b + 1]].tobytes() for b in full] for name, x in zip(("keys", "n", "value"), columns, strict=True)}
        yield pa.RecordBatch.from_pydict({"bucket": full, "asks": [False] * len(full), "at": [b""] * len(full), "rows": [b""] * len(full)} | parts, schema=ASKED)


def scores(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """Base and model log10 probabilities of each text; learnt from the documents that aren't held out.

    One row for each row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. A null or empty text is one end token. Repeated rows
    count and are scored each; a null doc_id counts as the empty string in the
    split. Columns other than doc_id and text are ignored. Without training
    texts every count is 0; an empty table gives no rows.
    """
    docs = held_out_docs(docs)
    train = docs.filter("not held_out").select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(BUCKETS, -(-size // BUCKET_BYTES))
    n, v, table = automaton(train, buckets)
    heavy = F.col("weight") >= max(1, -(-n // head))
    got = table.filter(heavy).select("key", "n", "value").toArrow()
    keys = got["key"].to_numpy().view(_U)
    order = np.argsort(keys)
    context = docs.sparkSession.sparkContext
    common = context.broadcast((tx.Keys(keys[order]), got["n"].to_numpy()[order], got["value"].to_numpy()[order]))
    tail = table.filter(~heavy).select("key", "n", "value")
    among = context.broadcast(key_filter(tail.select("key")))
    root = float(np.log10(n + v + 1))
    # a bucket of the tail is held by one task: they are larger, since a row of sums comes from each
    wide = max(BUCKETS, buckets // 8)

    def score(chunk: tx.Chunk) -> dict:
        keys, n, value = common.value
        hashes, doc = tokens_of(chunk)
        n_tokens = np.bincount(doc, minlength=len(chunk)).astype(np.int64)
        known, base, model = np.zeros((3, len(chunk)))
        every = runs(hashes, 3)
        for size in (1, 2, 3):
            at = places(doc, size)
            place = keys.find(every[size - 1][at])
            here, place = doc[at[place >= 0]], place[place >= 0]
            for total, column in ((known, n[place] > 0), (base, np.log10(n[place] + 1.0)), (model, value[place])):
                total += np.bincount(here, column, len(chunk))
        return {"row": chunk.batch.column(2), "doc_id": chunk.batch.column(0), "held_out": chunk.batch.column(3), "n_tokens": n_tokens, "n_known": known.astype(np.int64), "base": base - root * n_tokens, "model": model - root * n_tokens}

    def asking(k: int) -> Callable:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in tx.slices(batches, ASK_BYTES):
                hashes, doc = tokens_of(chunk)
                keys, where, every = [], [], runs(hashes, 3)
                for size in (1, 2, 3):
                    at = places(doc, size)
                    grams = every[size - 1][at]
                    some = np.flatnonzero(grams % _U(ROUNDS) == k)
                    some = some[passes(among.value, grams[some])]
                    some = some[common.value[0].find(grams[some]) < 0]
                    keys.append(grams[some])
                    where.append(doc[at[some]].astype(np.int32))
                keys, where = np.concatenate(keys), np.concatenate(where)
                order = np.argsort(keys)
                keys, where, ids = keys[order], where[order], chunk.batch.column(2).to_numpy()
                cut = cuts(keys, wide)
                rows: dict[str, list] = {name: [] for name in ASKED.names}
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    named, at = np.unique(where[cut[b] : cut[b + 1]], return_inverse=True)
                    for name, x in zip(ASKED.names, (b, True, keys[cut[b] : cut[b + 1]].tobytes(), b"", b"", at.astype(np.int32).tobytes(), ids[named].tobytes()), strict=True):
                        rows[name].append(x)
                yield pa.RecordBatch.from_pydict(rows, schema=ASKED)

        return run

    def met(k: int) -> DataFrame:
        mine = tail.filter(F.pmod("key", F.lit(ROUNDS)) == k).mapInArrow(lambda batches: _packed_table(batches, wide), tx.ddl(ASKED))
        asked = docs.mapInArrow(asking(k), tx.ddl(ASKED))
        answers = by_bucket(mine.union(asked), wide, "bucket", "asks").mapInArrow(_answers, tx.ddl(SUMS))
        return stored(answers.groupBy("row").agg(*[F.sum(c).alias(c) for c in SUMS.names[1:]]))

    rare = None
    for k in range(ROUNDS):
        one = met(k)
        _free(docs)
        rare = one if rare is None else rare.union(one)
    forget(table)
    # repeated rows ask for the same n-grams again, which are to count once for their row
    times = docs.groupBy("row").agg(F.count("*").alias("times"))
    rare = rare.groupBy("row").agg(*[F.sum(c).alias(f"rare_{c}") for c in SUMS.names[1:]]).join(times, "row")
    part = lambda name: F.coalesce(F.col(f"rare_{name}") / F.col("times"), F.lit(0))
    scored = tx.map_chunks(docs, score, SCORES)
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + part("known")).cast("bigint").alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + part("base")).alias("base_score"),
        (F.col("model") + part("value")).alias("score"),
    )
