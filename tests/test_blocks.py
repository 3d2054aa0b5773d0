"""Ordered operators over many blocks, with one key that has most rows, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import blocks, numbers, patterns, registry


@pytest.mark.parametrize("n", [1, 3, 9])
def test_nearest_over_blocks_equals_all_pairs(spark, n):
    rng = random.Random(n)
    of = lambda: rng.choice([0.0, 1.0, -2.0, rng.uniform(-9, 9), float(rng.randrange(1, 9))])
    key = lambda: rng.choice([7, 7, 7, 7, 1, None])
    left, right = [(key(), of(), k) for k in range(400)], [(key(), of()) for k in range(60)]
    got = numbers.nearest(spark.createDataFrame(left, "doc_id int, value double, k int"), spark.createDataFrame(right, "doc_id int, value double"), ["doc_id"], n)
    got = {r.k: (r.nearest, r.rel_diff) for r in got.collect()}
    want = {}
    for d, v, k in left:
        if v:
            best = min(((abs(v - w) / max(abs(v), abs(w)), w) for e, w in right if e == d and w * v > 0), default=(None, None))
            want[k] = (best[1], best[0])
    assert got == want


def followed(rows):
    """(event_id, from_state, to_state, claimed_by) of allowed events by the rules, one event at a time."""
    state, claimer, out = {}, {}, []
    for task, _, event_id, event, agent in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.get(task, "pending")
        to = {"verify": "verified", "fail": "regressed"}.get(event) or ("in_progress" if event == "start" and s in ("pending", "regressed") else "claimed" if event == "complete" and s == "in_progress" else None)
        if to:
            state[task] = to
            claimer[task] = agent if event == "start" else claimer.get(task)
            out.append((event_id, s, to, claimer.get(task)))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 4, 13])
@pytest.mark.parametrize("weights", [(5, 5, 1, 1), (5, 5, 0, 0), (1, 9, 1, 0), (9, 1, 0, 1)])
def test_tasks_over_blocks_follow_the_rules(spark, n, weights):
    rng = random.Random(sum(weights) * n)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), k // 3, k, rng.choices(["start", "complete", "verify", "fail"], weights)[0], rng.choice(["a", "b", None])) for k in range(260)]
    events = spark.createDataFrame(rows, "task_id long, ts long, event_id long, event string, agent_id string")
    got = registry.claimed_transitions(events, n)
    assert sorted((r.event_id, r.from_state, r.to_state, r.claimed_by) for r in got.collect()) == followed(rows)
    assert sorted(registry.transitions(events, n).columns) == sorted([*events.columns, "from_state", "to_state"])


def test_a_hot_key_lies_in_many_blocks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id")).alias("k"), F.rand(1).alias("v"))
    dealt = blocks.in_blocks(rows, ["k"], ["v"], 8)
    assert dealt.filter("k = 1").select(blocks.BLOCK).distinct().count() >= 6
    assert blocks.over_borders(dealt, ["k"]).select("k").distinct().count() <= 8


def test_success_is_the_claimers(spark):
    rows = [(1, 1, 1, "start", "ann", None), (1, 2, 2, "complete", "bob", "m1"), (1, 3, 3, "verify", "eve", "m2"), (1, 4, 4, "fail", None, None), (2, 1, 5, "verify", "ann", "m1"), (3, 1, 6, "start", None, "m1"), (3, 2, 7, "fail", "ann", "m1")]
    events = spark.createDataFrame(rows, "task_id long, ts long, event_id long, event string, agent_id string, model_id string").withColumn("difficulty", F.lit(2))
    got = {r.model_id: (r.attempts, r.successes, r.failures, r.success_rate) for r in registry.model_performance(events).collect()}
    assert got == {"m1": (1, 0, 0, None), "ann": (0, 1, 1, 0.5)}


def test_numbers_within_a_band_equal_all_pairs(spark):
    rng = random.Random(3)
    of = lambda: rng.choice([0.0, float("inf"), float("nan"), 100.0, 95.0, 105.0, 95.2, -100.0, -104.9, rng.uniform(90, 120), 10.0 ** rng.randrange(-300, 300)])
    left, right = [(rng.randrange(2), of(), k) for k in range(200)], [(rng.randrange(2), of(), k) for k in range(200)]
    for tolerance in (0.05, 0.1):
        got = numbers.within(spark.createDataFrame(left, "d int, a double, i int"), spark.createDataFrame(right, "d int, b double, j int"), ["d"], "a", "b", tolerance)
        want = [(i, j) for d, a, i in left for e, b, j in right if d == e and a and 0 < abs(b - a) / abs(a) <= tolerance]
        assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bin" in plan and "Cartesian" not in plan


def test_patterns_equal_contains(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("12.5e") for _ in range(n))
    texts = [(rng.choice([1, 1, 1, 2, 3]), word(rng.randrange(0, 30))) for _ in range(300)] + [(1, None), (None, "12")]
    wanted = [(rng.choice([1, 2, 4]), word(rng.randrange(0, 5))) for _ in range(80)] + [(1, None), (None, "12")]
    found = patterns.occurrences(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(wanted, "k int, pattern string"), "k")
    want = {(k, p) for k, p in wanted if p and k is not None and any(t and p in t for j, t in texts if j == k)}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    both = patterns.anywhere(spark.createDataFrame([(t,) for _, t in texts], "text string"), spark.createDataFrame([(p,) for _, p in wanted], "pattern string"))
    assert {tuple(r) for r in both.collect()} == {(t, p) for _, t in texts for _, p in wanted if t and p and p in t}


def test_groups_of_patterns(spark, monkeypatch):
    monkeypatch.setattr(patterns, "GROUP", 3)
    texts = spark.createDataFrame([(f"x{k}y{k + 1}",) for k in range(40)], "text string")
    wanted = spark.createDataFrame([(f"y{k}",) for k in range(40)], "pattern string")
    got = {tuple(r) for r in patterns.anywhere(texts, wanted).collect()}
    assert got == {(f"x{k}y{k + 1}", f"y{j}") for k in range(40) for j in range(40) if f"y{j}" in f"x{k}y{k + 1}"}
    assert patterns.anywhere(texts, wanted.filter("false")).isEmpty()
