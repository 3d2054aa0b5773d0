"""Claims with numbers, and the code that should contain these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.findings import finding, together
from scriptorium.operators.lines import with_heading
from scriptorium.operators.numbers import CLAIM_NUMBER, CLAIM_SECTIONS
from scriptorium.operators.patterns import occurrences
from scriptorium.tables import stored


def claims(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, heading, claim, numbers): lines with numbers in sections on results."""
    numbers = F.transform(F.regexp_extract_all("line", F.lit(CLAIM_NUMBER), F.lit(0)), lambda x: F.trim(x))
    headed = lines if "heading" in lines.columns else with_heading(lines)
    inside = headed.filter(F.col("heading").rlike(CLAIM_SECTIONS))
    return inside.select("doc_id", "line_no", "heading", F.trim("line").alias("claim"), numbers.alias("numbers")).filter(F.size("numbers") > 0)


#: Characters of a number that code is not searched for; `f` and the backslash are among those of the project this follows.
DROPPED = r"%\\fold x"


def searched(number, dropped: str = DROPPED) -> F.Column:
    """What is looked for in code: a number without the characters of a regular expression's class, in either case."""
    return F.regexp_replace(F.regexp_replace(number, f"(?i)[{dropped}]", ""), r"^\s+|\s+$", "")


def without_evidence(found: DataFrame, code: DataFrame, dropped: str = DROPPED) -> DataFrame:
    """The claims none of whose numbers occurs, as a substring, in code(repo_id = doc_id, line); dropped: as in searched.

    An automaton over a manuscript's distinct numbers reads the lines of its
    repository that have a digit, each once.
    """
    wanted = found.select("doc_id", F.explode("numbers").alias("number")).withColumn("pattern", searched(F.col("number"), dropped)).filter("pattern <> ''")
    lines = code.filter(F.col("line").rlike("[0-9]")).select(F.col("repo_id").alias("doc_id"), F.col("line").alias("text"))
    hit = occurrences(lines, wanted.select("doc_id", "pattern"), "doc_id")
    supported = found.select("doc_id", "line_no", F.explode("numbers").alias("number")).withColumn("pattern", searched(F.col("number"), dropped)).join(hit, ["doc_id", "pattern"], "left_semi").select("doc_id", "line_no").distinct()
    return found.join(supported, ["doc_id", "line_no"], "left_anti")


def evidence(lines: DataFrame, code: DataFrame, dropped: str = DROPPED) -> DataFrame:
    """Findings: manuscripts without claims, without code, and claims without evidence in code; dropped: as in searched."""
    found = stored(claims(lines))
    docs = lines.select("doc_id").distinct()
    has_code = code.select(F.col("repo_id").alias("doc_id")).distinct()
    with_claims = found.select("doc_id").distinct()
    gaps = without_evidence(found, code, dropped).join(has_code, "doc_id", "left_semi")
    return together(
        [
            finding(docs.join(with_claims, "doc_id", "left_anti"), "evidence", "no_claims_found", "info", line=F.lit(0)),
            finding(with_claims.join(has_code, "doc_id", "left_anti"), "evidence", "no_code_files", "info", line=F.lit(0)),
            finding(gaps, "evidence", "claim_no_code_evidence", "warning", details=F.substring("claim", 1, 120)),
        ]
    )
