"""Line deduplication against an alignment of all pairs of documents."""

import hashlib
import random
import re

import pytest

from scriptorium.llm import linededup
from scriptorium.llm.linededup import aligned, blocks_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_places(rows):
    """For each row the places of its lines in blocks that any earlier document has."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    sets = [set(lines) - {""} for _, lines in split]
    holders = {}
    for k, lines in enumerate(sets):
        for line in lines:
            holders.setdefault(line, []).append(k)
    out = []
    for k, (i, b) in enumerate(split):
        near = {j for line in sets[k] for j in holders[line] if i is not None and split[j][0] is not None and split[j][0] < i}
        words = [len(WORD.findall(line)) for line in b]
        out.append(sorted({y for j in near for y in blocks_of(split[j][1], b, words)}))
    return split, out


def digest(lines, gone):
    return hashlib.sha256("\n".join(line for k, line in enumerate(lines) if k not in set(gone)).encode()).hexdigest()


@pytest.mark.parametrize("which", ["small", "tricky"])
def test_equals_all_pairs(which, request):
    docs = request.getfixturevalue(which)
    split, gone = removed_places([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert any(gone)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((i, len(lines), len(g), digest(lines, g)) for (i, lines), g in zip(split, gone, strict=True)), key=key)
    assert sorted(map(tuple, linededup.without_shared_lines(docs).collect()), key=key) == want


def test_lines_that_stand_first_elsewhere(spark):
    shared = [f"line{k} has four words" for k in range(8)]
    rows = [(k, f"{shared[k]}\nown text {k} of this document") for k in range(8)]
    rows += [(k, "\n".join([f"begin {k}", *shared, f"end {k}"])) for k in (20, 21)]
    got = {r.doc_id: r.n_removed for r in linededup.without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: n for i, n in got.items() if n} == {21: 8}


def test_a_short_line_at_the_end_of_a_block(spark):
    long, five = " ".join(f"a{k}" for k in range(19)), "one two three four five"
    rows = [(1, f"{long}\n{five}"), (5, f"{long}\n{five}\nend"), (9, f"{long}\n{five}\nend")]
    got = {r.doc_id: r.n_removed for r in linededup.without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 5: 2, 9: 3}


def test_random_corpora_equal_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for corpus in range(30):
        pool = [" ".join(f"{corpus}w{k}x{j}" for j in range(rng.choice([0, 1, 3, 5, 9, 19]))) for k in range(24)]
        for k in range(7):
            lines = []
            for _ in range(rng.randrange(1, 4)):
                a = rng.randrange(24)
                lines += pool[a : a + rng.randrange(1, 9)] + [f"own {corpus} {k} {rng.random()}"] * rng.randrange(2)
            rows.append((corpus * 100 + k, "\n".join(lines)))
    split, gone = removed_places(rows)
    want = {i: (len(lines), digest(lines, g)) for (i, lines), g in zip(split, gone, strict=True)}
    got = {r.doc_id: (r.n_lines, r.kept_sha256) for r in linededup.without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(map(bool, gone)) > 60 and got == want


@pytest.mark.parametrize("others", [50, 150])
def test_how_many_others_have_a_line_changes_nothing(spark, others):
    block = [f"item {k} of" for k in range(11)]
    rows = [(k, "\n".join([f"head {k}", *block])) for k in (1, 2)] + [(100 + k, f"{block[0]}\nown {k}\n{block[3]}") for k in range(others)]
    got = {r.doc_id: r.n_removed for r in linededup.without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: n for i, n in got.items() if n} == {2: 11}


def test_moved_and_repeated_blocks():
    one, two = [f"a{k}" for k in range(6)], [f"b{k}" for k in range(6)]
    assert blocks_of([*one, "x", *two], [*two, "y", *one], [4] * 13) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]
    assert blocks_of(["s"] * 9, ["s"] * 9, [3] * 9) == list(range(9)) and blocks_of(one, two, [9] * 6) == []


def test_alignment_rises_and_joins_equal_lines():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = aligned(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_columns_of_any_name_stay_as_they_are(spark):
    text = "\n".join(f"line {k} has five words" for k in range(6))
    names = ["doc_id", "text", "cut_here", "cut_key", "cut_lines", "cut_text", "n_chars", "row", "gone", "a.b`c"]
    rows = [(1, text, "h", "k", "l", "t", len(text), 5, "g", "x"), (2, f"{text}\nand more", "h", "k", "l", "t", len(text) + 9, 6, "g", "y"), (None, text, "h", "k", "l", "t", 7, 8, "g", "z"), (4, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join("`" + n.replace("`", "``") + "` " + ("long" if n in ("n_chars", "row") else "string") for n in names[2:]))
    got = linededup.with_lines_removed(docs)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], (2, "and more", "h", "k", "l", "t", 8, 6, "g", "y"), rows[2], rows[3]], key=str)


def test_no_documents(no_documents):
    assert linededup.without_shared_lines(no_documents).collect() == [] and linededup.with_lines_removed(no_documents).collect() == []
