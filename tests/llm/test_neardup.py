import random
import re
from collections import Counter, defaultdict

import pytest

from scriptorium.llm import graph, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    """{doc_id: component} by comparing all documents that share a shingle; rows of one doc_id are one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    holders, common = defaultdict(list), Counter()
    for k, (_, s) in enumerate(sets):
        for g in s:
            for other in holders[g]:
                common[other, k] += 1
            holders[g].append(k)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), both in common.items():
        if 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = find(sets[a][0]), find(sets[b][0])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("which", ["small", "tricky"])
def test_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute([r for r in rows if r[0] is not None])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(list)
    for i, t in rows:
        sizes[i].append(len(shingles(t)))
    for r in got:
        assert r.n_shingles in sizes[r.doc_id]
        if r.doc_id is not None:
            if r.n_shingles or len(sizes[r.doc_id]) == 1:
                assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert len(set(want.values())) < len(want)


def test_no_documents(no_documents):
    assert neardup.near_duplicates(no_documents).collect() == []


def test_no_link_is_lost_in_a_large_bucket_of_near_copies(spark):
    """Copies that differ pairwise near the limit, with the leader at the rim of the group."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(150):
        words = base.copy()
        for _ in range(rng.choice([0, 2, 3, 4, 5, 6])):
            words[rng.randrange(200)] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    for n, m in ((1, 1), (40, 25), (300, 260)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1064)]
        root = {x: x for e in edges for x in e}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: find(x) for x in linked}
