import re
from collections import Counter

import pytest

from scriptorium.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)

    def covered(n):
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        often = Counter(grams)
        hit = set()
        for k, g in enumerate(grams):
            if often[g] > 1:
                hit.update(range(k, k + n))
        return hit

    repeat = covered(3)
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    chars = {n: sum(len(words[k]) for k in covered(n)) for n in quality.GRAM_LIMITS}
    total = max(1, sum(map(len, words)))
    seen, line_chars = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            line_chars += sum(map(len, WORD.findall(line))) * (line in seen)
            seen.add(line)
    good = line_chars <= quality.LINE_LIMIT * total and all(chars[n] <= limit * total for n, limit in quality.GRAM_LIMITS.items())
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), line_chars, *chars.values(), failed, good and not failed)


@pytest.mark.parametrize("which", ["small", "tricky"])
def test_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    texts = sorted(((r.doc_id is None, r.doc_id or 0), *brute(r.text)) for r in docs.select("doc_id", "text").collect())
    got = sorted(((r.doc_id is None, r.doc_id or 0), *r[1:]) for r in quality.repetition(docs).collect())
    assert got == texts


def test_empty_table(no_documents):
    assert quality.repetition(no_documents).collect() == []


def test_repetition_is_rejected_and_prose_kept(spark, small):
    kept = [r.kept for r in quality.repetition(small).collect()]
    assert sum(kept) > 0.5 * len(kept)
    fresh = [f"word{k}" for k in range(400)]
    passage = fresh[:90]
    lines = "\n".join(" ".join(fresh[k : k + 10]) for k in range(0, 200, 10))
    rows = [(1, " ".join(fresh)), (2, " ".join([*fresh, *passage])), (3, " ".join([*fresh, *passage, "new", *passage[:30]])), (4, lines), (5, "\n".join([lines, *lines.split("\n")[:4]]))]
    got = {r.doc_id: r for r in quality.repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False}
