"""Benchmark passages against a search of all runs of words of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import decontam
from scriptorium.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(words, n):
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]


def brute(docs, items):
    """{(doc_id, item_id): highest similarity of a run} where it is 0.75 or more; doc_ids are distinct."""
    items = [(i, w, min(5, len(w))) for i, w in ((i, words_of(t)) for i, t in items) if w]
    counts = Counter(s for _, w, n in items for s in set(shingles(w, n)))
    weight = lambda s: math.log1p(len(items) / max(1, counts[s]))
    out = {}
    for d, text in docs:
        words = words_of(text)
        by_size = {n: shingles(words, n) for n in {n for _, _, n in items}}
        present = {n: set(x) for n, x in by_size.items()}
        for i, w, n in items:
            own = set(shingles(w, n))
            whole = sum(map(weight, own))
            if sum(map(weight, own & present[n])) < 0.75 * whole - 1e-9:
                continue
            at = [k for k, s in enumerate(by_size[n]) if s in own]
            for a in at:
                seen, both, union = set(), 0.0, whole
                for s in by_size[n][a : at[-1] + 1]:
                    if s not in seen:
                        seen.add(s)
                        both, union = (both + weight(s), union) if s in own else (both, union + weight(s))
                    if both / union >= 0.75 - 1e-12:
                        out[d, i] = max(out.get((d, i), 0), both / union)
                    if union * 0.75 > whole:
                        break
    return out


@pytest.fixture(scope="module")
def planted(spark, small):
    """Items of the test tables, edited, within texts of the test tables."""
    rng = random.Random(9)
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    rows = []
    for k, (i, text) in enumerate(small.select("doc_id", "text").limit(400).collect()):
        own = (text or "").split()
        for _ in range(k % 3):
            part = items[rng.randrange(len(items))][1].split()
            for _ in range(rng.randrange(1 + len(part) // 18)):
                at = rng.randrange(len(part) - 3)
                part[at : at + rng.randrange(3)] = rng.choices(["edited", "words", "here"], k=rng.randrange(3))
            at = rng.randrange(len(own) + 1)
            own[at:at] = part
        rows.append((i, " ".join(own)))
    return rows, items


def test_equals_exhaustive_search(spark, planted):
    rows, items = planted
    got = {}
    for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got[r.doc_id, r.item_id] = max(got.get((r.doc_id, r.item_id), 0), r.similarity)
    want = brute(rows, items)
    assert len(want) > 100 and not set(got) - set(want)
    # SimHash finds all but a few; what it finds has its exact similarity
    assert len(got) >= 0.99 * len(want)
    assert all(abs(want[k] - s) < 1e-9 for k, s in got.items())


def test_all_passages_of_an_item(spark):
    item, other = [f"i{k}" for k in range(40)], [f"f{k}" for k in range(60)]
    texts = [item + item, item + other + item + item, item[:38] + item, other + item * 30]
    docs = spark.createDataFrame([(k, " ".join(t), "x") for k, t in enumerate(texts)], "doc_id long, text string, similarity string")
    got = sorted((r.doc_id, r.start, r.n_words) for r in decontam.leaks(docs, spark.createDataFrame([(1, " ".join(item), 5)], "item_id long, text string, start int")).collect())
    assert got == [(0, 0, 40), (0, 40, 40), (1, 0, 40), (1, 100, 40), (1, 140, 40), (2, 0, 38), (2, 38, 40), *((3, 60 + 40 * k, 40) for k in range(30))]


def test_long_items_and_texts(spark, tricky):
    rng = random.Random(3)
    item = [f"l{rng.randrange(9000)}" for _ in range(40_000)]
    changed = [w if k % 90 != 45 else "new" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join([*(f"f{k}" for k in range(500)), *changed])), (2, " ".join(item[:20_000]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string")
    got = decontam.leaks(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and got[0].start == 500 and got[0].n_words == 40_000
    tricky_rows = [tuple(r) for r in tricky.select("doc_id", "text").collect() if r.doc_id not in (None, 13, 17)]
    benchmark = spark.createDataFrame([(k, t) for k, t in tricky_rows if k in (10, 13, 18, 5)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(tricky, benchmark).collect() if r.doc_id not in (None, 13, 17)}
    assert {(10, 10), (11, 10), (12, 10), (18, 18), (19, 10), (5, 5), (6, 5)} <= found and not {d for d, _ in found} & set(range(100, 230))


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 1 << 63, 300, np.uint64)
    prints = items[rng.integers(0, 300, 900)]
    for _ in range(26):
        prints ^= np.uint64(1) << rng.integers(0, 64, 900, np.uint64)
    group = decontam.SizeClass(40, 40, list(range(300)), items)
    want = {(w, k) for w in range(900) for k in np.flatnonzero(np.bitwise_count(items ^ prints[w]) <= decontam.RADIUS).tolist()}
    assert len(want) > 50 and set(zip(*(x.tolist() for x in group.near(prints)), strict=True)) == want


def test_many_items(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(20, 90)))) for k in range(20_000)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=60)) + " " + items[k * 37][1] + " tail") for k in range(300)]
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start) for r in got) == [(k, 37 * k, 60) for k in range(300)]


def test_text_slices_do_not_change_passages(planted):
    rows, items = planted
    n = len([1 for _, t in items if words_of(t)])
    bench = decontam.Benchmark(items, n, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    found = [sorted(x for chunk in tx.slices([batch], size) for x in zip(*(decontam.leaks_of(chunk, bench)[c].to_pylist() for c in decontam.LEAKS.names), strict=True)) for size in (1 << 12, 1 << 24)]
    assert found[0] == found[1] and found[0]
