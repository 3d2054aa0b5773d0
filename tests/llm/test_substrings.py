import hashlib
import random
import re

import pytest

from scriptorium.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - 49):
                g = tuple(w[k : k + 50])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < i:
                    gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append(((i is None, i or 0), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("which", ["small", "tricky"])
def test_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert result(substrings.without_repeats(docs)) == want
    assert any(r[2] for r in want)


def test_periodic_and_overlapping_repeats(spark):
    rng = random.Random(2)
    rows = [(1, "a b " * 100), (2, "b a " * 60), (3, "a " * 300), (4, "a " * 120 + "b " * 70), (5, "b " * 49), (6, "a " * 50)]
    long = [f"t{rng.randrange(30)}" for _ in range(3000)]
    for i in range(7, 40):
        a = rng.randrange(2800)
        rows.append((i, " ".join(long[a : a + rng.randrange(45, 200)] + [f"z{i}"] + long[a + 3 : a + 70])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(substrings.without_repeats(docs)) == brute(rows)


def test_text_is_what_the_digest_says(tricky, no_documents):
    for r in substrings.without_repeats(tricky, with_text=True).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    assert substrings.without_repeats(no_documents).collect() == []
