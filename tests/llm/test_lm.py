import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
END = object()


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), END]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Model:
    """The automaton with dictionaries."""

    def __init__(self, train):
        self.c1, self.c2, self.c3 = (Counter(g for t in train for g in zip(*(t[k:] for k in range(size)), strict=False)) for size in (1, 2, 3))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.c2, self.c3 = ({g: c for g, c in counts.items() if c >= 2} for counts in (self.c2, self.c3))
        count, taken = self.c1 | self.c2, Counter()
        for g, c in (self.c2 | self.c3).items():
            taken[g[:-1]] += c - 0.5
        self.fail = {g: 1 - taken[g] / c for g, c in count.items()}
        p1 = {w: self.root(w) for w in self.c1}
        p2 = {g: (c - 0.5) / count[g[:1]] + self.fail[g[:1]] * p1[g[1:]] for g, c in self.c2.items()}
        p3 = {g: (c - 0.5) / count[g[:2]] + self.fail[g[:2]] * p2[g[1:]] for g, c in self.c3.items()}
        self.arcs = p2 | p3

    def root(self, w):
        return (self.c1[w] + 1) / (self.n + self.v + 1)

    def step(self, state, w):
        """(weight of the path, next state)."""
        weight, at = 1.0, state
        while at and (*at, w) not in self.arcs:
            weight *= self.fail[at]
            at = at[1:]
        weight *= self.arcs[*at, w] if at else self.root((w,))
        state = (*state, w)[-2:]
        while state and state not in self.fail:
            state = state[1:]
        return weight, state


def brute(rows):
    """Base and model scores, one token after the other."""
    model, out = Model([tokens(t) for i, t in rows if not held(i)]), []
    for i, t in rows:
        state, score, base = (), 0.0, 0.0
        text = tokens(t)
        for w in text:
            base += math.log10(model.root((w,)))
            weight, state = model.step(state, w)
            score += math.log10(weight)
        out.append(((i is None, i or 0), held(i), len(text), sum(model.c1[w,] > 0 for w in text), model.n, base, score))
    return sorted(out, key=lambda r: (r[0], r[2], r[5]))


def close(got, want):
    got = sorted((((r.doc_id is None, r.doc_id or 0), *r[1:]) for r in got), key=lambda r: (r[0], r[2], r[5]))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


@pytest.mark.parametrize("which", ["small", "tricky"])
def test_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    close(lm.scores(docs).collect(), brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))


@pytest.mark.parametrize("head", [1, 200])
def test_few_broadcast_values_score_alike(tricky, head, monkeypatch):
    monkeypatch.setattr(lm, "BUCKETS", 3)
    close(lm.scores(tricky, head=head).collect(), brute([tuple(r) for r in tricky.select("doc_id", "text").collect()]))


def test_a_full_filter_lets_all_pass(tricky, monkeypatch):
    monkeypatch.setattr(lm, "passes", lambda bits, keys: keys == keys)
    close(lm.scores(tricky, head=50).collect(), brute([tuple(r) for r in tricky.select("doc_id", "text").collect()]))


def test_key_filter(spark):
    keys = [-(1 << 63), -1, 0, 1, (1 << 63) - 1, *range(1 << 40, 1 << 60, 1 << 52)]
    bits = lm.key_filter(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert lm.passes(bits, np.array(keys, np.int64).view(np.uint64)).all() and np.bitwise_count(bits).sum() <= len(keys)
    assert not lm.passes(bits, np.array([3 << 61], np.uint64)).any()


def test_no_documents(no_documents):
    assert lm.scores(no_documents).collect() == []


def test_model_beats_the_base_on_held_out_texts(small):
    rows = [r for r in lm.scores(small).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_of_each_history_sum_to_one():
    rng = random.Random(2)
    model = Model([[*rng.choices("abcdef", [9, 5, 3, 2, 1, 1], k=30), END] for _ in range(9)])
    for state in [(), *model.fail]:
        if END not in state:
            assert sum(model.step(state, w)[0] for w in [*"abcdef", END, "new"]) == pytest.approx(1)
