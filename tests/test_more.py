"""Papers, scripts, history, streams, and numbers' contexts against plain Python."""

import re

from pyspark.sql import functions as F

from scriptorium.operators import citations, history, lines, numbers, paper, reproduction, statistics
from scriptorium.operators.findings import finding
from scriptorium.sources import manuscripts
from scriptorium.streaming import audits


def lines_frame(spark, text, ext=".tex"):
    return lines.lines_of(spark.createDataFrame([(1, ext, text)], "doc_id long, ext string, text string"))


def test_contexts_are_forty_characters_on_either_side(spark):
    text = "\n".join(["x" * 50 + " 12.5 mg and " + "y" * 60 + " 3 days, 3 days" + " z" * 30, "a 4-fold b 5x, c", "p = 0.01 of 7 %", "é 1.2.3 1.5", ""])
    got = sorted((r.line_no, r.kind, r.value, r.context) for r in numbers.prose_numbers(lines_frame(spark, text).withColumn("section", F.lit("body"))).collect())
    want = []
    for k, line in enumerate(text.split("\n"), 1):
        for kind, pattern in numbers.PROSE_NUMBERS:
            for m in re.finditer(pattern, line, re.IGNORECASE):
                want.append((k, kind, m[0].strip(), line[max(0, m.start() - 40) : m.end() + 40].strip()))
    assert got == sorted(want) and len(want) > 8


def test_what_stands_near_a_p_value_may_be_broken_over_lines(spark):
    text = "We had a sample size\nof 40 in all.\np = 0.032\nplain\n" + "x\n" * 6 + "p = 0.05"
    rows = {(r.line_no, r.issue) for r in statistics.statistics(lines_frame(spark, text)).collect()}
    assert rows == {(3, "no_test_named"), (11, "no_test_named"), (11, "no_sample_size"), (11, "round_p_value"), (3, "no_multiple_comparison_correction"), (0, "no_power_analysis")}
    assert [r.issue for r in statistics.statistics(lines_frame(spark, "no difference")).collect()] == ["no_p_values"]


def test_similar_family_names_are_one(spark):
    rows = [(["Mueller, A.", "Bob Johanson"], ["Muller", "Johansson"]), (["Smith, A."], ["Jones", "Smith-Lee"]), ([], ["x"]), (None, ["x"]), (["Ann Lee"], ["Brown"])]
    got = citations.with_author_overlap(spark.createDataFrame(rows, "a array<string>, b array<string>"), "a", "b", "o").collect()
    assert [r.o for r in got] == [1.0, 0.5, None, None, 0.0]


def test_scripts_and_what_they_print(spark):
    text = "See `a.py`, `b.py`, `c.py`, `d.py` and `e.py`.\nThe mean was 100.0 and 7."
    each = lines_frame(spark, text)
    outputs = spark.createDataFrame([(1, "a.py", 1, "5", "boom"), (1, "b.py", 0, " \n", ""), (1, "c.py", 0, "done", ""), (1, "d.py", 0, "103.0 and 7 and 900", None)], "doc_id long, script string, exit_code int, stdout string, stderr string")
    scripts = spark.createDataFrame([(1, f"/r/{n}.py") for n in "abcd"] + [(2, "/r/e.py")], "doc_id long, path string")
    named = manuscripts.resolved(manuscripts.script_references(each), scripts)
    got = {(r.matched_text, r.issue, r.severity) for r in reproduction.reproducibility(each, named, outputs).collect()}
    assert got == {("a.py", "script_failed", "critical"), ("b.py", "no_output", "warning"), ("c.py", "no_numbers_in_output", "info"), ("103.0", "number_discrepancy", "warning")}
    none = reproduction.reproducibility(lines_frame(spark, "nothing"), named.limit(0), outputs).collect()
    assert [(r.issue, r.severity) for r in none] == [("no_scripts_found", "info")]


def test_tables_against_outputs(spark):
    docs = spark.createDataFrame([(1, r"\begin{tabular}{l} a & 100.0 \\ b & 7 \\ c & 50 \end{tabular}"), (2, "none"), (3, r"\begin{tabular}{l} a & 1 \end{tabular}")], "doc_id long, text string")
    outputs = spark.createDataFrame([(1, "s.py", 0, "108.0 7 900", ""), (2, "s.py", 0, "1", ""), (3, "s.py", 0, "none", "")], "doc_id long, script string, exit_code int, stdout string, stderr string")
    got = {(r.doc_id, r.severity, r.issue): r.details for r in reproduction.verified_numbers(docs, outputs).collect()}
    assert {k[:3] for k in got} == {(1, "info", "tables_parsed"), (1, "info", "output_parsed"), (1, "warning", "table_code_mismatch"), (1, "info", "verification_summary"), (2, "info", "no_tables_found"), (3, "info", "tables_parsed"), (3, "warning", "no_numbers_in_output")}
    assert got[1, "info", "verification_summary"] == "2 matched, 1 apart" and got[1, "info", "tables_parsed"] == "3 numbers, 1 tables"


def test_table_numbers_have_the_line_of_their_row(spark):
    text = "\n".join(["intro", r"\begin{longtable}{l} 1 \\", r" 2 & 3 \hline", r"\end{longtable} x \begin{tabular}{l}", "4", r"\\ 5 & $6 \times 10^{2}$", r"\end{tabular} and \begin{tabular}{l} 7 \\ \end{tabular}", r"\begin{tabular*}{l}", r"8 \end{tabular*}"])
    got = [(r.table_index, r.line_no, r.raw) for r in numbers.table_numbers(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")).collect()]
    assert sorted(got) == [(0, 6, "4"), (0, 7, "5"), (0, 7, r"6 \times 10^{2}"), (1, 7, "7"), (2, 9, "8"), (3, 2, "1"), (3, 3, "2"), (3, 3, "3")]


def test_declared_papers(spark):
    models = spark.createDataFrame([("p", "heart", 1, None, "hours", 4, 2), ("p", "gut", 2, "", "minutes", 3, 1), ("p", "lung", 2, "draft", "hours", 1, 0)], "paper_id string, name string, tier int, label string, time_unit string, n_equations int, n_calibrated int")
    couplings = spark.createDataFrame([("p", "heart", "gut"), ("p", "heart", "lung"), ("p", "heart", "skin")], "paper_id string, source string, target string")
    stats = spark.createDataFrame([("p", "mean", 10.0, "10.0"), ("p", "text", 99.0, "n/a"), ("p", "none", 55.0, "55")], "paper_id string, name string, value double, raw string")
    outputs = spark.createDataFrame([("p", "mean 10.2 and n/a.")], "paper_id string, stdout string")
    assert [r.name for r in paper.unlabelled_models(models).collect()] == ["gut"]
    assert sorted((r.target, r.target_unit) for r in paper.coupled_units(couplings, models).collect()) == [("gut", "minutes"), ("skin", "unknown")]
    checked = paper.statistics_found(stats, outputs)
    assert {r.name: r.verified for r in checked.collect()} == {"mean": True, "text": True, "none": False}
    assert [tuple(r) for r in paper.audit(models, checked).collect()] == [("p", 3, 8, 4, 4, 3, 3, 2)]
    claims = spark.createDataFrame([("p", 1, "The first study"), ("q", 1, "The first study")], "paper_id string, claim_no int, text string")
    assert [r.paper_id for r in paper.priority_warnings(claims, spark.createDataFrame([("p", 0), ("q", 2)], "paper_id string, n_terms int")).collect()] == ["p"]


def test_history_is_appended_and_newest_first(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3, "critical", "a"), (1, 4, "info", "b"), (2, 1, "warning", "c")], "doc_id long, line_no int, severity string, issue string")
    found = finding(rows, "statistics", F.col("issue"), F.col("severity"))
    for run, at in (("r1", "2024-01-01"), ("r2", "2024-03-01"), ("r3", "2024-02-01")):
        history.store(found, str(tmp_path), run, at)
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert [(r.run_id, r.doc_id, r.n_critical) for r in history.history(runs).collect()] == [("r2", 1, 1), ("r2", 2, 0), ("r3", 1, 1), ("r3", 2, 0), ("r1", 1, 1), ("r1", 2, 0)]
    assert [r.run_id for r in history.history(runs, doc_id=2, check_type="statistics", limit=2).collect()] == ["r2", "r3"]
    assert [r.severity for r in history.findings_of(spark, str(tmp_path), "r2").collect()] == ["critical", "info", "warning"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, ".tex", "It is proven.\nplain"), (2, ".tex", None)], "doc_id long, ext string, text string").write.parquet(str(source))
    docs = spark.readStream.schema("doc_id long, ext string, text string").parquet(str(source))
    query = audits.append_to(audits.claim_language(docs), str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert [(r.doc_id, r.line_no, r.pattern_name) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 1, "proof_language")]
    events = tmp_path / "events"
    spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00', 1, 'start'), (1, timestamp'2024-01-01 01:00:00', 2, 'complete'), (2, timestamp'2024-01-02 00:00:00', 3, 'fail') AS t(task_id, ts, event_id, event)").selectExpr("CAST(task_id AS BIGINT) AS task_id", "ts", "CAST(event_id AS BIGINT) AS event_id", "event").write.parquet(str(events))
    stream = spark.readStream.schema("task_id long, ts timestamp, event_id long, event string").parquet(str(events))
    query = audits.task_states(stream).writeStream.format("memory").queryName("states").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert {r.task_id: r.state for r in spark.table("states").collect()} == {1: "claimed", 2: "regressed"}
