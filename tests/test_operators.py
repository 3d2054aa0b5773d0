import hashlib
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import citations, lines, numbers, paper, parameters, registry, statistics, time_units
from scriptorium.sources import folders, manuscripts

BIB = """% a comment
@article{gupta2007, title = {Inclusion of the Serotonin system}, author = {Gupta, Shakti and Aslakson, Eric and Gurbaxani, Brian}, doi = {10.1186/1742-4682-7-34}, journal = {Theor Biol}, year = {2010}}
@string{x = {y}}
@book{two, title = "A Long
 title", author = {M\\"{u}ller, Hans}, year = 1999,}
@article{three, title = {No doi {inside} here}, year = {2001}}
"""


def test_bibliography(spark):
    got = {r.key: r for r in citations.entries(spark.createDataFrame([(1, BIB), (2, ""), (3, None)], "bib_id long, text string")).collect()}
    assert list(got) == ["gupta2007", "two", "three"]
    first = got["gupta2007"]
    assert "Serotonin" in first.title and len(first.authors) == 3 and first.doi == "10.1186/1742-4682-7-34" and first.year == "2010"
    assert "Long" in got["two"].title and len(got["two"].authors) == 1 and got["three"].doi == "" and got["three"].title == "No doi {inside"


def test_titles_and_dois(spark):
    pairs = [("same", "same"), ("A model of stress", "A model of the stress"), ("abc", "xyz"), ("", "x"), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", citations.similarity(F.col("a"), F.col("b")).alias("s"))
    assert all(r.s == SequenceMatcher(None, r.a or "", r.b or "").ratio() for r in df.collect())
    one = spark.range(1).select(citations.normalized(F.lit("{Some  Title}\\")).alias("t"), citations.clean_doi(F.lit("https://doi.org/10.1/X")).alias("d")).first()
    assert (one.t, one.d) == ("some title", "10.1/X")


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(1)
    left = [(rng.randrange(5), rng.choice([0.0, 1.0, -2.0, rng.uniform(-9, 9), float(rng.randrange(1, 9))]), k) for k in range(400)]
    right = [(rng.randrange(5), rng.choice([0.0, 1.5, rng.uniform(-9, 9), float(rng.randrange(1, 9))])) for k in range(300)]
    got = {r.k: (r.nearest, r.rel_diff) for r in numbers.nearest(spark.createDataFrame(left, "doc_id int, value double, k int"), spark.createDataFrame(right, "doc_id int, value double"), ["doc_id"]).collect()}
    for d, v, k in left:
        if v == 0:
            assert k not in got
            continue
        best = min(((abs(v - w) / max(abs(v), abs(w)), w) for e, w in right if e == d and w * v > 0), default=(None, None))
        assert got[k] == (best[1], best[0])


def test_both_p_value_patterns_count(spark):
    docs = spark.createDataFrame([(1, ".tex", "group = 3 and p = 0.05")], "doc_id long, ext string, text string")
    rows = statistics.p_values(lines.lines_of(docs)).collect()
    assert sorted(r.value for r in rows) == [0.0, 0.05, 3.0, 3.0]


def test_number_literals_of_code(spark):
    source = 'a = 1\nself.b = -2.5\nc = "x"\nd = {"k": 3, "n": -1}\nsteady_state = [1.0, 2.0, other, 4]\n'
    got = [(r.kind, r.name, r.line_no, r.value) for r in parameters.literals(spark.createDataFrame([(1, source), (2, "def ("), (3, None)], "file long, source string")).collect()]
    assert sorted(got) == [("assignment", "a", 1, 1.0), ("assignment", "self.b", 2, -2.5), ("dict", "k", 4, 3.0), ("steady_state", "steady_state", 5, 2.0)]


def test_rates_hit_both_patterns(spark):
    code = spark.createDataFrame([(1, 1, "# Units: time in hours"), (1, 2, "k = 1  # 1/min"), (1, 3, "m = 2  # 1/day -> converted to 1/hr")], "file long, line_no int, line string")
    got = time_units.unit_mismatches(code).collect()
    assert sorted((r.line_no, r.unit, r.issue) for r in got) == [(2, "minutes", "internal_unit_mismatch")] * 2 + [(3, "days", "documented_unit_conversion")] * 2


def test_direct_calls(spark):
    models = spark.createDataFrame([(1, "hpa_axis", 1, "time in hours"), (2, "hpt", 1, "time in minutes")], "file long, stem string, line_no int, line string")
    code = spark.createDataFrame([(9, 1, "y = hpa_ode(t, x)"), (9, 6, "y = hpt_ode(t / 60, x)"), (9, 12, "z = other_ode(t)")], "file long, line_no int, line string")
    assert [(r.line_no, r.function, r.unit) for r in time_units.direct_calls(models, code).collect()] == [(1, "hpa_ode", "hours")]
    assert {r.issue for r in time_units.time_units(models, code).collect()} >= {"time_unit_detected", "direct_t_pass", "multiple_time_units", "time_conversion_present"}


def test_tasks_follow_the_rules(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(20), k, k, rng.choice(["start", "complete", "verify", "fail"])) for k in range(500)]
    state = {}
    for task, _, _, event in rows:
        s = state.setdefault(task, "pending")
        if event in ("verify", "fail"):
            state[task] = "verified" if event == "verify" else "regressed"
        elif event == "start" and s in ("pending", "regressed"):
            state[task] = "in_progress"
        elif event == "complete" and s == "in_progress":
            state[task] = "claimed"
    got = registry.task_states(spark.createDataFrame(rows, "task_id long, ts long, event_id long, event string"))
    assert {r.task_id: r.state for r in got.collect()} == state


def test_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.tex").write_text("It is proven in `fit.py`.\n")
    (tmp_path / "sub" / "b.md").write_text("plain")
    (tmp_path / "sub" / "fit.py").write_text("x = 1")
    docs = manuscripts.manuscripts(spark, str(tmp_path))
    assert sorted(r.name for r in docs.collect()) == ["a.tex", "b.md"]
    refs = manuscripts.script_references(lines.lines_of(docs))
    scripts = manuscripts.files(spark, str(tmp_path), ".py").select(F.col("file").alias("path"))
    assert manuscripts.resolved(refs, scripts).first().path.endswith("/sub/fit.py")


def test_code_of_every_name_and_solvers_beside_the_models(spark, tmp_path):
    names = ("models/__init__.py", "models/_constants.py", "models/.hidden.py", "models/heart.py", "models/solver.py", "solver.py", "plot.py", "coupling/gut.py", "coupling/__init__.py")
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\ny = 2")
    every = manuscripts.code_lines(spark, str(tmp_path))
    assert sorted((r.file.split(f"{tmp_path}/")[1], r.line_no) for r in every.collect()) == sorted((name, k) for name in names for k in (1, 2))
    models = manuscripts.model_lines(manuscripts.code_lines(spark, f"{tmp_path}/models"))
    assert {r.name for r in models.collect()} == {"_constants.py", ".hidden.py", "heart.py", "solver.py"}
    assert sorted({r.file.split(f"{tmp_path}/")[1] for r in manuscripts.solvers(every, f"{tmp_path}/models").collect()}) == ["coupling/gut.py", "solver.py"]


def test_files_are_read_by_partition(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"_{k}.TXT").write_bytes(b"\xff" + b"x" * k)
    spark.dataSource.register(folders.TextFiles)
    df = spark.read.format(folders.NAME).options(path=f"file://{tmp_path}", extensions=".txt,.md", partitionBytes=60).load()
    assert df.rdd.getNumPartitions() > 5 and sorted(len(r.text) for r in df.collect()) == list(range(1, 31))
    assert manuscripts.files(spark, f"{tmp_path}/_3.TXT").first().text == "\ufffdxxx"
    with pytest.raises(FileNotFoundError):
        manuscripts.manuscripts(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        manuscripts.manuscripts(spark, str(tmp_path), (".py",))


def test_scripts_in_the_manuscripts_folder(spark):
    refs = spark.createDataFrame([(1, 1, "fit.py"), (1, 2, "sub/run.py")], "doc_id long, line_no int, script string")
    scripts = spark.createDataFrame([("/repo/deep/fit.py", "/repo"), ("/paper/fit.py", "/repo"), ("/repo/sub/run.py", "/repo"), ("/paper/sub/run.py", "/repo")], "path string, root string")
    where = spark.createDataFrame([(1, "/paper")], "doc_id long, folder string")
    got = {r.line_no: r.path for r in manuscripts.resolved(refs, scripts, where).collect()}
    assert got == {1: "/paper/fit.py", 2: "/repo/sub/run.py"}


def test_figures_have_the_start_of_their_digest(spark, tmp_path):
    (tmp_path / "plot.png").write_bytes(b"\x00picture")
    row = paper.figure_digest(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert row.digest == hashlib.sha256(b"\x00picture").hexdigest()[:16]


def test_evidence_names_no_model_for_verification(spark):
    rows = [(1, 1, 1, "start"), (1, 2, 2, "start"), (1, 3, 3, "complete"), (1, 4, 4, "verify"), (2, 1, 5, "complete"), (2, 2, 6, "fail"), (3, 1, 7, "complete")]
    events = spark.createDataFrame(rows, "task_id long, ts long, event_id long, event string").withColumn("model_id", F.lit(7))
    got = [(r.task_id, r.event_id, r.to_state, r.model_id, r.state) for r in registry.task_evidence(events).collect()]
    assert got == [(1, 1, "in_progress", "7", "verified"), (1, 3, "claimed", "7", "verified"), (1, 4, "verified", "", "verified"), (2, 6, "regressed", "", "regressed")]
    assert [r.task_id for r in registry.task_evidence(events, "regressed").collect()] == [2]
    assert registry.task_evidence(events.filter("false")).isEmpty()
    assert {(r.event_id, r.transition, r.code_version) for r in registry.evidence(events, "0123456789abcdef").filter("task_id = 1").collect()} == {(1, "pending->in_progress", "0123456789ab"), (3, "in_progress->claimed", "0123456789ab"), (4, "claimed->verified", "0123456789ab")}


def test_bounds_of_likeness_hold(spark):
    rng = random.Random(9)
    pairs = [("".join(rng.choice("abcd é.$") for _ in range(rng.randrange(12))), "".join(rng.choice("abcd é.$") for _ in range(rng.randrange(12)))) for _ in range(300)]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", citations.most_alike(F.col("a"), F.col("b")).alias("m")).collect():
        assert r.m == pytest.approx(SequenceMatcher(None, r.a, r.b).quick_ratio()) and r.m + 1e-12 >= SequenceMatcher(None, r.a, r.b).ratio()


def test_overlap_equals_python(spark):
    rng = random.Random(10)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
    rows = [([name() for _ in range(rng.randrange(4))], [name() for _ in range(rng.randrange(4))]) for _ in range(200)]
    same = lambda a, b: a in b or b in a or SequenceMatcher(None, a, b).ratio() > 0.8
    got = citations.with_author_overlap(spark.createDataFrame(rows, "a array<string>, b array<string>"), "a", "b", "o").collect()
    assert all(r.o == (sum(any(same(a, b) for b in r.b) for a in r.a) / max(len(r.a), len(r.b)) if r.a and r.b else None) for r in got)


def test_context_of_output(spark):
    rows = numbers.output_numbers(spark.createDataFrame([(1, "s", f"  x\t12 {'y' * 200}  \nz")], "doc_id long, script string, stdout string")).collect()
    assert [(r.line_no, r.raw, r.context) for r in rows] == [(1, "12", f"x\t12 {'y' * 200}"[:120])]
