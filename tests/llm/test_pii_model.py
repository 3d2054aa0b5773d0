"""What the tagger adds: held-out veiled spans, and nothing on texts that have none."""

import re
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import pii


def with_one_span(text, kind, rng):
    words = [w.lower() for w in re.findall("[A-Za-z]{3,9}", text)] or ["name"]
    while True:
        new = pii.veiled(pii.made_up(kind, words, rng), kind, rng)
        at = max(0, text.find(" ", int(rng.integers(0, len(text) - 20))))
        out = f"{text[:at]} {new} {text[at:]}"
        if pii.plausible(out, at + 1, at + 1 + len(new), kind):
            return out, f"{kind}:{at + 1}:{at + 1 + len(new)}"


@pytest.fixture(scope="module")
def found(spark, small):
    """{doc_id: (text, true span or None, spans, base spans)}; the model learns from all, its spans are of other seeds."""
    rng = np.random.default_rng(77)
    plain = [tuple(r) for r in small.select("doc_id", "text").collect()]
    usable = [t for _, t in plain if 200 <= len(t or "") <= 3000 and not pii.base_spans(t)][:400]
    made = [with_one_span(t, pii.KINDS[k % 4], rng) for k, t in enumerate(usable)]
    rows = plain + [(1_000_000 + k, t) for k, (t, _) in enumerate(made)] + [(2_000_000, "write to jane.doe (at) example.com please"), (2_000_001, None), (2_000_002, "")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = lambda t: [f"{k}:{a}:{b}" for a, b, k in pii.base_spans(t or "")]
    truth = {1_000_000 + k: s for k, (_, s) in enumerate(made)}
    return {i: (t, truth.get(i), [s for s in got[i].spans.split(",") if s], base(t), got[i]) for i, t in rows}


def test_held_out_veiled_spans(found):
    true, hit, wrong = Counter(), Counter(), Counter()
    for _, span, spans, base, _ in found.values():
        if span:
            true[span.split(":")[0]] += 1
            for s in set(spans) - set(base):
                (hit if s == span else wrong)[s.split(":")[0]] += 1
    print({k: f"recall {hit[k] / true[k]:.2f}, precision {hit[k] / max(1, hit[k] + wrong[k]):.2f}" for k in pii.KINDS})
    for kind in pii.KINDS:
        assert true[kind] == 100 and hit[kind] >= 85 and wrong[kind] <= 8


#: Forms by themselves; the last four are in none of the pairs that the model learns from.
FORMS = ("{a} at {b} dot com", "{A} AT {B} DOT COM", "{a} AT {b} DOT com", "{a}.{c} at {b} dot net", "{a}{{at}}{b}.org", "{a} (at) {b} dot com", "{a} [at] {b} [dot] com", "{a} dot {c}7 at mail3 dot {b} dot com", "{a}.{c}(at){b}.com", "{a} (at) {b} [dot] com", "{a}[at]{b} dot com", "{a} [at] {b}(dot)org", "{a} {{at}} {b} dot net")


def test_each_form_of_address(spark, small):
    rng = np.random.default_rng(5)
    plain = [tuple(r) for r in small.select("doc_id", "text").collect()]
    usable = [t for _, t in plain if 200 <= len(t or "") <= 3000 and not pii.base_spans(t)]
    rows, truth = list(plain), {}
    for f, form in enumerate(FORMS):
        for k in range(40):
            text = usable[(f * 40 + k) % len(usable)]
            a, b, c = rng.choice(["jane", "miller", "sato", "robin", "kim", "okafor", "lind", "example", "library", "garden"], 3, replace=False)
            new = form.format(a=a, b=b, c=c, A=a.upper(), B=b.upper())
            at = max(0, text.find(" ", int(rng.integers(0, len(text) - 20))))
            rows.append((5_000_000 + f * 100 + k, f"{text[:at]} {new} {text[at:]}"))
            truth[rows[-1][0]] = f"email:{at + 1}:{at + 1 + len(new)}"
    got = {r.doc_id: r.spans.split(",") for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [sum(truth[5_000_000 + f * 100 + k] in got[5_000_000 + f * 100 + k] for k in range(40)) for f in range(len(FORMS))]
    print(dict(zip(FORMS, found, strict=True)))
    assert min(found) >= 32 and min(found[:3]) >= 36 and sum(found) >= 0.9 * 40 * len(FORMS)
    base = lambda t: {f"{k}:{a}:{b}" for a, b, k in pii.base_spans(t or "")}
    assert sum(len(set(got[i]) - {""} - base(t)) for i, t in plain) <= 3


def test_plain_texts_get_no_more_than_their_base_spans(found):
    extra = [s for i, (_, _, spans, base, _) in found.items() if i < 1_000_000 for s in set(spans) - set(base)]
    assert len(extra) <= 3


def test_an_address_without_digits_and_empty_texts(found):
    assert found[2_000_000][2] == ["email:9:34"] and found[2_000_000][4].n_email == 0 and found[2_000_000][4].n_spans == 1
    assert all(found[i][4].spans == "" and found[i][4].n_spans == 0 for i in (2_000_001, 2_000_002))


def test_base_spans_stay(found):
    assert all(set(base) <= set(spans) for _, _, spans, base, _ in found.values())


def test_no_documents_and_no_spans_to_learn_from(spark, no_documents):
    assert pii.personal_data(no_documents).collect() == []
    got = pii.personal_data(spark.createDataFrame([(1, "plain words only", 3), (None, "at home. dot", 4)], "doc_id long, text string, n_spans int")).collect()
    assert [(r.n_spans, r.spans) for r in got] == [(0, "")] * 2


def test_overlapping_windows_agree_on_a_long_text():
    rng = np.random.default_rng(1)
    tags = np.zeros(1000, np.int64)
    for a in range(40, 960, 60):
        tags[a], tags[a + 1 : a + 30] = 1, 2
    starts = list(range(0, 1000 - pii.WINDOW + pii.STRIDE, pii.STRIDE))
    paths = np.stack([np.pad(tags[s : s + pii.WINDOW], (0, max(0, s + pii.WINDOW - 1000))) for s in starts])
    edge = np.arange(pii.WINDOW)
    paths[:, (edge < 8) | (edge >= pii.WINDOW - 8)] = np.where(rng.random((len(starts), 16)) < 0.5, 0, paths[:, (edge < 8) | (edge >= pii.WINDOW - 8)])
    got = pii.reconciled(1000, starts, paths)
    assert (got[8:-16] == tags[8:-16]).all() and pii.spans_of(tags) == [(a, a + 30, "email") for a in range(40, 960, 60)]
