import pytest
from pyspark.sql import functions as F

from scriptorium.operators import findings, language, lines


def found(spark, text, ext=".tex"):
    docs = spark.createDataFrame([(1, ext, text)], "doc_id long, ext string, text string")
    return [(r.issue, r.severity, r.line_no, r.matched_text, r.details) for r in language.overclaims(lines.lines_of(docs)).orderBy(findings.rank(), "line_no").collect()]


@pytest.mark.parametrize(
    ("text", "issue"),
    [
        ("We have proven that the model is correct.", "proof_language"),
        ("This result proves the hypothesis.", "proof_language"),
        ("The model was validated against experimental data.", "validated"),
        ("It is impossible to do so.", "impossible"),
        ("to machine precision", "machine_precision"),
        ("to machine-precision", "machine_precision"),
        ("statistically   indistinguishable groups", "statistically_indistinguishable"),
        ("This confirms it.", "confirms_demonstrates"),
        ("This demonstrates that it works.", "confirms_demonstrates"),
        ("Clearly so.", "clearly_obviously"),
        ("an unprecedented result", "priority_claim"),
        ("\\begin{abstract}\nA novel view.\n\\end{abstract}", "novel_in_abstract"),
    ],
)
def test_claim_language_is_found(spark, text, issue):
    assert issue in [f[0] for f in found(spark, text)]


@pytest.mark.parametrize("text", ["It was qualitatively validated.", "It has not validated this.", "% This is proven", "A novel view.\n\\begin{abstract}\nplain\n\\end{abstract}", "We measured levels.\nThey rose.\nThey fell.", "", "always positive, never zero"])
def test_nothing_is_found(spark, text):
    assert found(spark, text) == []


def test_other_kinds_of_files(spark):
    assert found(spark, "It is proven.", ".md")[0][0] == "proof_language"
    assert found(spark, "a <!-- proven --> b", ".md") == []
    assert len(found(spark, "proven <!-- proven --> proven", ".md")) == 2
    assert len(found(spark, "100 % proven", ".txt")) == 1
    assert found(spark, "100\\% proven") and not found(spark, "100 % proven")


def test_order_line_and_context(spark):
    got = found(spark, "one\ntwo\nThis proves it.\nClearly this proves the impossible result is validated.")
    assert len(got) > 3 and [f[1] for f in got] == sorted((f[1] for f in got), key=list(findings.SEVERITIES).index)
    assert got[0][2] == 3 and got[0][4] == "This proves it."


def test_letters_are_unicode(spark):
    assert found(spark, "éproven") == []


def test_line_ends(spark):
    docs = spark.createDataFrame([(1, ".tex", "a\r\nb\rc\x0bd\n\ne\n"), (2, ".tex", None), (3, ".tex", "")], "doc_id long, ext string, text string")
    assert [(r.doc_id, r.line_no, r.line) for r in lines.lines_of(docs).orderBy("doc_id", "line_no").collect()] == [(1, k + 1, x) for k, x in enumerate(["a", "b", "c", "d", "", "e"])]


def test_ratings(spark):
    rows = [(5, 0, "reject"), (2, 0, "major_revision"), (1, 0, "major_revision"), (0, 5, "major_revision"), (0, 2, "minor_revision"), (0, 1, "accept")]
    df = spark.createDataFrame(rows, "c long, w long, want string")
    assert df.filter(findings.rating(F.col("c"), F.col("w")) != F.col("want")).count() == 0
