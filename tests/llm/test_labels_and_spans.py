"""URL rules, personal data, toxicity and benchmark passages against plain Python."""

import hashlib
import re

import pytest

from scriptorium.llm import decontam, pii, toxicity, urls

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


@pytest.mark.parametrize("which", ["small", "tricky"])
def test_base_spans(which, request):
    docs = request.getfixturevalue(which)
    want = sorted(((r.doc_id is None, r.doc_id or 0), hashlib.sha256(",".join(brute_spans(r.text or "")).encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    got = pii.personal_data(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.base_sha256) for r in got) == want


def test_url_rules(spark):
    given = ["http://a.example.com/en/7x", "https://EXAMPLE.com/en/1?x", "http://b.net/de/8", "http://example.net/de/8", "x.org/es/", "http://c.org/es/#a", None, "", "ftp://h", "http://ü.com/en/é", "http://a.com"]
    rows = [(k, u, "clash") for k, u in enumerate(given)] + [(None, "http://q.net/de/", "r"), (1, given[1], "rule")]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert len(got) == len(rows)
    rules = {r.page_id: (r.host, r.rule) for r in got}
    assert rules[0] == ("a.example.com", "example.com/en/7") and rules[1] == ("example.com", "com/en/") and rules[2][1] == "net/de/" and rules[3][1] == "example.net/de/8"
    assert rules[4] == ("", None) and rules[5][1] == "org/es/" and rules[6] == rules[7] == ("", None) and rules[9] == ("ü.com", "com/en/") and rules[None][1] == "net/de/"
    assert all(r.verdict in ("allow", "block") for r in got)
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_toxicity_learns_words_and_their_misspellings(spark, tricky, no_documents):
    filler = [f"plain{k % 97} words{k % 89} here{k % 83}" for k in range(400)]
    rows = [(k, f"{' '.join(filler[k % 50 : k % 50 + 9])} {'despicable' if k % 4 == 0 else 'agreeable'} end") for k in range(400)]
    docs = spark.createDataFrame([*rows, (9001, "plain1 words2 despicabble here3"), (9002, "plain1 words2 here3"), (9003, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(400)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [got[k] for k in range(400) if got[k].held_out]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert got[9001].score > got[9002].score and 0 <= got[9003].score <= 1 and not got[None].held_out
    assert toxicity.toxicity(no_documents, labels).collect() == []
    assert len(toxicity.toxicity(tricky, labels.limit(0)).collect()) == tricky.count()


def test_benchmark_passages(spark, tricky, no_documents):
    benchmark = spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(40))), (2, "two words"), (3, None), (4, " ")], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(200))
    near = " ".join("x" if k == 20 else f"I{k}" for k in range(40))
    rows = [(1, f"{filler} {near} {filler}"), (2, filler), (3, " ".join(f"i{k}" for k in range(0, 40, 2))), (4, "some two words here"), (5, None), (None, f"{near}")]
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert set(got) == {(1, 1), (None, 1), (4, 2)} and got[1, 1].start == 200 and got[1, 1].n_words == 40
    assert decontam.leaks(no_documents, benchmark).collect() == [] and decontam.leaks(tricky, benchmark.limit(0)).collect() == []


def test_url_rules_say_what_the_contract_lists(spark):
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {rule: says for says, rule in urls.RULES} == said
    given = ["http://a.com/en/1", "http://b.example.com/en/7", "http://c.net/de/8", "http://example.net/de/8", "http://d.org/es/x", "http://example.net/de/7"]
    got = urls.judged(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == ["block", "allow", "allow", "block", "block", "allow"]
    assert all(r.verdict == said[r.rule] for r in got)
