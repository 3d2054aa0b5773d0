"""The language model keeps what occurs twice, however many training tokens there are."""

from scriptorium.llm import lm
from test_lm import brute, close, held


def test_a_repeated_ngram_counts_in_a_large_corpus(spark):
    # over 100,000 * 2 training tokens, so that a bound that grows with them would drop all but the filler
    filler = " ".join(f"w{k % 700}" for k in range(3000))
    learnt, new = [k for k in range(200, 250) if not held(k)][:2], [k for k in range(300, 400) if held(k)][:2]
    rows = [(k, filler) for k in range(1, 101)] + [(k, "seldom seen words meet") for k in learnt]
    rows += [(new[0], "seldom seen words meet"), (new[1], "meet words seen seldom")]
    want = brute(rows)
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    close(got, want)
    of = {r.doc_id: r.score for r in got}
    assert of[new[0]] > of[new[1]] + 1 and got[0].train_tokens > 200_000
    close(lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), head=20).collect(), want)
