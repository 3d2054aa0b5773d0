"""Tables kept by key, declarations in order, dependencies, JSON lists and orders, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import dependencies, findings, history, paper, registry
from scriptorium.sources import keyed


def test_rows_are_replaced_by_key(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), ("a", "b"), {"state": "'new'", "n": "0"})
    rows = lambda *x: spark.createDataFrame(list(x), "a string, b int, title string")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(rows(("x", 1, "one"), ("x", 2, "two"), (None, 1, "null")))
    first = table.version()
    table.update(spark.createDataFrame([("x", 1, "done", 3), ("x", 9, "done", 3)], "a string, b int, state string, n int"))
    assert sorted(map(str, map(tuple, table.read().collect()))) == sorted(map(str, [("x", 1, "one", "done", 3), ("x", 2, "two", "new", 0), (None, 1, "null", "new", 0)]))
    table.replace(rows(("x", 1, "again"), ("x", 1, "last"), (None, 1, "null too"), ("y", 1, "more")), F.length("title"))
    assert sorted(map(str, map(tuple, table.read().collect()))) == sorted(map(str, [("x", 1, "again", "new", 0), ("x", 2, "two", "new", 0), (None, 1, "null too", "new", 0), ("y", 1, "more", "new", 0)]))
    assert spark.read.parquet(f"{tmp_path}/t/{first}").count() == 3
    table.drop_others()
    assert len(list((tmp_path / "t").glob("v-*"))) == 1 and table.read().count() == 4
    plan = table.read().filter("a = 'y'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,y)" in plan


def test_a_writer_that_fails_leaves_the_table(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), ("a",), {})
    table.replace(spark.range(3).withColumnRenamed("id", "a"))
    with pytest.raises(Exception, match="boom"):
        table.replace(spark.range(9).select(F.expr("if(id < 8, id, raise_error('boom'))").cast("bigint").alias("a")))
    assert table.read().count() == 3


def test_runs_are_read_alone(spark, tmp_path):
    found = spark.range(2000).select(F.lit("statistics").alias("check_type"), F.col("id").alias("doc_id"), F.lit(1).alias("line_no"), F.lit("info").alias("severity"), F.lit("x").alias("issue"))
    for run in ("r1", "r2", "r3"):
        history.store(found, f"{tmp_path}/runs", run, run)
    history.compact(spark, f"{tmp_path}/runs", f"{tmp_path}/few")
    for folder in ("runs", "few"):
        rows = history.findings_of(spark, f"{tmp_path}/{folder}", "r2")
        assert rows.count() == 2000 and {r.run_id for r in rows.select("run_id").distinct().collect()} == {"r2"}
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(run_id,r2)" in plan


def followed(rows):
    claim = method = model = paper_id = None
    out = []
    for p, seq, kind in sorted(rows):
        if p != paper_id:
            claim = method = model = None
            paper_id = p
        owner, status = None, "ignored"
        if kind == "claim":
            claim, status = seq, "open"
        elif kind == "method":
            claim, method, model, status = None, seq, None, "open"
        else:
            owner = claim if kind in paper.NEEDS_CLAIM + paper.MAY_LACK_CLAIM else method if kind in paper.NEEDS_METHOD + paper.MAY_LACK_METHOD else model
            status = "attached" if owner is not None else "error" if kind in paper.NEEDS_CLAIM + paper.NEEDS_METHOD else "ignored"
            if kind == "model" and method is not None:
                model = seq
        out.append((p, seq, kind, owner, status))
    return out


@pytest.mark.parametrize("n", [1, 7])
def test_declarations_belong_to_what_is_open(spark, n):
    rng = random.Random(n)
    kinds = [*paper.NEEDS_CLAIM, *paper.MAY_LACK_CLAIM, *paper.NEEDS_METHOD, *paper.MAY_LACK_METHOD, *paper.OF_MODEL, "claim", "method"]
    rows = [(p, k, rng.choice(kinds)) for p, size in ((1, 200), (2, 20), (3, 1)) for k in range(size)]
    got = paper.attached(spark.createDataFrame(rows, "paper_id int, seq int, kind string"), n)
    assert sorted(map(tuple, got.select("paper_id", "seq", "kind", "owner", "status").collect())) == followed(rows)
    claims = {(r.paper_id, r.seq): (r.n_evidence, r.issues) for r in paper.declared_claims(got).collect()}
    for p, seq, kind, _, _ in followed(rows):
        if kind == "claim":
            mine = [k for q, _, k, owner, _ in followed(rows) if q == p and owner == seq]
            missing = [name for name, k in (("no_evidence", "evidence"), ("no_citation", "citation")) if k not in mine]
            assert claims[p, seq] == (mine.count("evidence"), ",".join(missing))


def test_what_stands_behind_and_what_has_no_order(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("e", "e"), ("f", "e"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "z"), ("v", None), (None, "a"), ("b", "a")]
    df = spark.createDataFrame(edges, "task_id string, requires string")
    seeds = spark.createDataFrame([("a",), ("x",), (None,)], "task_id string")
    assert {(r.task_id, r.steps) for r in dependencies.behind(df, seeds).collect()} == {("b", 1), ("d", 1), ("c", 2), ("z", 1), ("y", 2), ("w", 2), ("x", 3)}
    assert {r.task_id for r in dependencies.without_order(df).collect()} == {"e", "f", "x", "y", "z", "w"}
    assert dependencies.behind(df.limit(0), seeds).isEmpty() and dependencies.without_order(df.limit(0)).isEmpty() and dependencies.without_order(df.filter("requires = 'a'")).isEmpty()


def test_lists_that_are_no_json_are_empty(spark):
    rows = spark.createDataFrame([('["a", "b"]',), ("[]",), ("[a",), ("{}",), (None,)], "t string").select(registry.listed(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [["a", "b"], [], [], [], []]


@pytest.mark.parametrize("n", [1, 6])
def test_issues_are_numbered_over_blocks(spark, n):
    rng = random.Random(n)
    rows = [("c", rng.choice([1, 1, 1, 2]), rng.randrange(50), rng.choice(["critical", "warning", "info", "odd"]), "i", str(k), "") for k in range(200)]
    found = spark.createDataFrame(rows, "check_type string, doc_id long, line_no int, severity string, issue string, matched_text string, details string")
    got = {(r.doc_id, r.severity, r.place): r.text for r in findings.printed_issues(found, blocks=n).collect()}
    want = {}
    for doc in (1, 2):
        for severity in ("critical", "warning", "info"):
            mine = sorted((r[2], r[4], r[5]) for r in rows if r[1] == doc and r[3] == severity)
            for place, (line, issue, matched) in enumerate(mine if severity != "info" else mine[:10], 1):
                want[doc, severity, place] = (f"[:{line}] " if line else "") + f"({issue}) {matched}"
            if severity == "info" and len(mine) > 10:
                want[doc, severity, 11] = f"... and {len(mine) - 10} more."
    assert got == want


def test_tasks_of_a_specification(spark):
    tasks = spark.createDataFrame([("b", 2, "verified"), ("a", 3, "pending"), ("a", 1, "verified")], "spec_id string, task_id int, state string")
    ids = lambda df: [r.task_id for r in df.collect()]
    assert (ids(registry.tasks_of(tasks)), ids(registry.tasks_of(tasks, "a")), ids(registry.tasks_of(tasks, state="verified")), ids(registry.tasks_of(tasks, "a", "verified"))) == ([1, 3, 2], [1, 3], [1, 2], [1])


def test_severity_alone_orders(spark):
    rows = [("info", 1), ("warning", 2), ("critical", 3), ("info", 4), ("critical", 5), ("odd", 6)]
    assert [r.n for r in findings.by_severity(spark.createDataFrame(rows, "severity string, n int").coalesce(1)).collect()] == [3, 5, 2, 1, 4, 6]
