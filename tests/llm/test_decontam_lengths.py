"""Benchmark passages longer or shorter than their item, and weights that don't depend on blocks."""

from scriptorium.llm import decontam

FILLER = [f"f{k}" for k in range(300)]


def docs_of(spark, passages):
    return spark.createDataFrame([(k, " ".join(FILLER + p + FILLER)) for k, p in enumerate(passages)], "doc_id long, text string")


def test_passages_of_other_lengths(spark):
    item = [f"i{k}" for k in range(100)]
    inserted = item[:50] + [f"x{k}" for k in range(15)] + item[50:]
    left_out = item[:40] + item[55:]
    scattered = list(item)
    for at in (75, 50, 25):
        scattered.insert(at, f"y{at}")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = decontam.leaks(docs_of(spark, [inserted, left_out, scattered, item]), benchmark).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 4
    assert {k: (r.start, r.n_words) for k, r in got.items()} == {0: (300, 115), 1: (300, 85), 2: (300, 103), 3: (300, 100)}
    # shingles of the item that the passage has, of all of both: a cut costs 4 of the item's 96
    for k, (both, other) in enumerate([(92, 111), (77, 81), (84, 99), (96, 96)]):
        assert abs(got[k].similarity - both / (96 + other - both)) < 1e-9


def test_blocks_give_the_verdicts_of_the_whole_benchmark(spark, monkeypatch):
    shared = [f"s{k}" for k in range(20)]
    items = [[f"i{n}_{k}" for k in range(40)] + shared for n in range(6)]
    benchmark = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)], "item_id long, text string")
    docs = docs_of(spark, [x[:40] + [f"z{k}" for k in range(20)] for x in items] + items)
    key = lambda rows: sorted((r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in rows)
    whole = key(decontam.leaks(docs, benchmark).collect())
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 1)
    assert key(decontam.leaks(docs, benchmark).collect()) == whole and len(whole) >= 6
