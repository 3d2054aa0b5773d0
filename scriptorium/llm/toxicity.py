"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams, a text the
average of its words, and a softmax over two classes reads the text; vectors
and softmax are trained jointly, in numpy, by Adam on the whole sample. A
misspelt word shares most n-grams with the word it stands for.

Texts are read in windows of `SPAN` words, half overlapping, since a few words
decide and would vanish in the average of a long text. A text scores as its
highest window, in training as in use.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import text as tx

#: The bound of the training sample: labelled rows of each class, and bytes of a text in it.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 1200, 2400, 1 << 15
BUCKETS, DIM, GRAMS = 1 << 17, 6, (3, 4, 5, 6)
#: n-grams of fewer training texts are not learnt.
MIN_TEXTS = 4
SPAN = 8
#: EASE damps the steps of n-grams of few texts, whose gradients are small: they would learn single labels by heart.
ROUNDS, RATE, DECAY, EASE = 26, 0.5, 1e-4, 1e-4
SAMPLE_CHUNK = 1 << 17

_U = np.uint64


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word between marks, and how many each word has; a word is one gram more."""
    wide = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(_U)
    size = np.array([len(w) + 2 for w in words], np.int64)
    of = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(wide)) - np.repeat(first, size)
    keys, owner = [], []
    for n in GRAMS:
        at = np.flatnonzero(place + n <= np.repeat(size, size))
        keys.append(tx.gram_hashes(wide, at, n))
        owner.append(of[at])
    whole = np.add.reduceat(wide * tx.powers(int(size.max()))[place], first) if len(words) else np.zeros(0, _U)
    keys.append(tx.mix(whole))
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(keys)[order] >> _U(47)).astype(np.int32), np.bincount(owner, minlength=len(words))


class Bag:
    """Words of some documents: word number of each token, windows as token ranges, document of each window."""

    def __init__(self, chunk: tx.Chunk):
        low = chunk.lowered()
        words = low.words
        _, index, self.token = np.unique(words.hashes, return_index=True, return_inverse=True)
        raw = low.buf.tobytes()
        self.words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[index].tolist(), words.ends[index].tolist(), strict=True)]
        self.token_doc = words.doc
        step = SPAN // 2
        n = np.maximum(1, -(-(words.counts - step) // step))
        self.doc = np.repeat(np.arange(len(chunk)), n)
        place = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        self.low = words.first[self.doc] + place * step
        self.high = np.minimum(self.low + SPAN, words.first[self.doc + 1])

    def mean(self, values: np.ndarray) -> np.ndarray:
        """The average of a value for each word, by window; 0 for a window without words."""
        total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values[self.token], axis=0)])
        n = np.maximum(self.high - self.low, 1).reshape(-1, *[1] * (values.ndim - 1))
        return (total[self.high] - total[self.low]) / n


def _texts_with(bag: Bag, buckets: np.ndarray, counts: np.ndarray, n_docs: int) -> np.ndarray:
    """In how many of the documents each bucket occurs."""
    ends = np.cumsum(counts)
    pairs = np.unique(bag.token_doc * np.int64(len(counts)) + bag.token)
    doc, word = pairs // max(len(counts), 1), pairs % max(len(counts), 1)
    m = counts[word]
    hit = buckets[np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat((ends - counts)[word], m)]
    return np.bincount(np.unique(hit * np.int64(n_docs) + np.repeat(doc, m)) // n_docs, minlength=BUCKETS)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(chunks: list[tx.Chunk], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(what each bucket adds to the log odds, the bias); labels has the class of each document in turn."""
    bags, at = [], 0
    for chunk in chunks:
        bag = Bag(chunk)
        buckets, counts = gram_buckets(bag.words)
        bags.append((bag, buckets, counts, labels[at : at + len(chunk)]))
        at += len(chunk)
    rng = np.random.default_rng(7)
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    if share.min() == 0:
        return np.zeros(BUCKETS), float(np.log((share[1] + 1e-3) / (share[0] + 1e-3)))
    vectors, soft, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.log(share)
    texts = np.zeros(BUCKETS, np.int64)
    for bag, buckets, counts, y in bags:
        texts += _texts_with(bag, buckets, counts, len(y))
    learnt = texts >= MIN_TEXTS
    vectors[~learnt] = 0
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, soft, bias)]
    for k in range(1, ROUNDS + 1):
        grads = [DECAY * vectors, DECAY * soft, np.zeros(2)]
        for bag, buckets, counts, y in bags:
            ends = np.cumsum(counts)
            word = np.add.reduceat(vectors[buckets], ends - counts) / counts[:, None] if len(counts) else np.zeros((0, DIM))
            window = bag.mean(word)
            z = window @ soft + bias
            # the window with the highest odds stands for its document
            odds = z[:, 1] - z[:, 0]
            order = np.lexsort((-odds, bag.doc))
            top = order[np.append(True, bag.doc[order][1:] != bag.doc[order][:-1])]
            delta = _softmax(z[top])
            delta[np.arange(len(top)), y] -= 1
            delta /= len(labels)
            grads[1] += window[top].T @ delta
            grads[2] += delta.sum(0)
            back = delta @ soft.T / np.maximum(bag.high - bag.low, 1)[top][:, None]
            n = (bag.high - bag.low)[top]
            tokens = bag.token[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bag.low[top], n)]
            live, where = np.unique(tokens, return_inverse=True)
            spread = np.stack([np.bincount(where, np.repeat(back[:, d], n), len(live)) for d in range(DIM)], 1) / counts[live][:, None]
            m = counts[live]
            hit = buckets[np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat((ends - counts)[live], m)]
            for d in range(DIM):
                grads[0][:, d] += np.bincount(hit, np.repeat(spread[:, d], m), BUCKETS)
        grads[0][~learnt] = 0
        for x, g, (m1, m2) in zip((vectors, soft, bias), grads, moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x -= RATE * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + EASE)
    return vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def score(chunk: tx.Chunk, bucket_odds: np.ndarray, bias: float) -> np.ndarray:
    """The probability of each document's highest window."""
    bag = Bag(chunk)
    if bag.words:
        buckets, counts = gram_buckets(bag.words)
        word = np.add.reduceat(bucket_odds[buckets], np.cumsum(counts) - counts) / counts
    else:
        word = np.zeros(0)
    odds = bag.mean(word) + bias
    best = np.full(len(chunk), -np.inf)
    np.maximum.at(best, bag.doc, odds)
    return 1 / (1 + np.exp(-best))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tx.Chunk], np.ndarray]:
    """The bounded training sample: of each class the labelled rows whose doc_id hashes lowest."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda label, n: usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = pick(1, TOXIC_ROWS).union(pick(0, CLEAN_ROWS))
    rows = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    chunks = [chunk for batch in rows.to_batches() for chunk in tx.slices([batch], SAMPLE_CHUNK)]
    return chunks, rows["toxic"].to_numpy().astype(np.int64)


def scorer(docs: DataFrame, labels: DataFrame) -> Callable[[Column], Column]:
    """A column function that scores texts, learnt from the labelled rows of docs."""
    odds, bias = train(*sample(tx.documents_of(docs), labels))
    shared = docs.sparkSession.sparkContext.broadcast((odds, bias))

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *(score(chunk, *shared.value) for chunk in tx.slices([batch]))]))

    return scored


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; only its text is scored.

    Learns from labelled documents whose crc32(doc_id) mod 5 isn't 0. A null
    or empty text scores as the bias. A null doc_id isn't held out and has no
    label. Repeated rows score alike. Labels that are null or neither 0 nor 1
    are ignored, and a doc_id with both counts as toxic. Without labels of both
    classes all texts get one score. Extra columns are ignored; an empty table
    gives no rows.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = tx.documents_of(docs).select("doc_id", held_out.alias("held_out"), scorer(docs, labels)("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
