"""The finding schema, severities, verdicts and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.blocks import in_blocks, numbered
from scriptorium.tables import dealt, stored

SEVERITIES = {"critical": 0, "warning": 1, "info": 2}
COLUMNS = ("check_type", "doc_id", "line_no", "severity", "issue", "matched_text", "details")


def rank(severity: str = "severity") -> Column:
    """0 critical, 1 warning, 2 info, 9 anything else."""
    return F.coalesce(*[F.when(F.col(severity) == s, r) for s, r in SEVERITIES.items()], F.lit(9))


def finding(df: DataFrame, check: str, issue: Column | str, severity: Column | str, line: Column | str = "line_no", matched: Column | None = None, details: Column | None = None) -> DataFrame:
    """df's rows as findings; what a check doesn't know is empty text or line 0."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit("")
    return df.select(
        F.lit(check).alias("check_type"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.col(line) if isinstance(line, str) else line).cast("int").alias("line_no"),
        lit(severity).alias("severity"),
        lit(issue).alias("issue"),
        F.coalesce(none if matched is None else matched, none).alias("matched_text"),
        F.coalesce(none if details is None else details, none).alias("details"),
    )


def together(parts: list[DataFrame]) -> DataFrame:
    """All findings of some checks; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def severity_counts(found: DataFrame, *keys: str) -> DataFrame:
    by = {f"n_{s}": F.count_if(F.col("severity") == s) for s in SEVERITIES}
    return found.groupBy(*keys).agg(*[c.alias(name) for name, c in by.items()], F.count("*").alias("n_findings"))


def rating(critical: Column, warning: Column) -> Column:
    """From 5 critical findings on reject, from 2 (or 1, or 5 warnings) major, from 2 warnings minor revision."""
    return F.when(critical >= 5, "reject").when((critical >= 1) | (warning >= 5), "major_revision").when(warning >= 2, "minor_revision").otherwise("accept")


def verdicts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each document: counts by severity, and the rating; without findings it is accepted."""
    names = [f"n_{s}" for s in SEVERITIES]
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(severity_counts(found, "doc_id"), "doc_id", "left")
    counts = joined.select("doc_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return counts.withColumn("rating", rating(F.col("n_critical"), F.col("n_warning")))


#: Findings that one task sorts: rows are small and alike, and too many of them fit the bytes by which Spark would deal.
SORTED_ROWS = 200_000


def _by_document(found: DataFrame) -> DataFrame:
    """found, stored, with a document's findings in one task and no more of them in a task than it sorts in little memory."""
    return dealt(stored(found), F.col("doc_id"), SORTED_ROWS)


def top_findings(found: DataFrame, n: int) -> DataFrame:
    """The n most severe findings of each document, by severity, line and issue, with their place; all columns are stored on the way."""
    order = Window.partitionBy("doc_id").orderBy(rank(), "line_no", "issue", "matched_text")
    return _by_document(found).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def by_severity(found: DataFrame) -> DataFrame:
    """All findings by severity alone; within one they stay as they came."""
    return found.withColumn("_came", F.monotonically_increasing_id()).orderBy(rank(), "_came").drop("_came")


def severity_rollup(found: DataFrame) -> DataFrame:
    """Counts by check and severity, by check, and of all; totals have null keys."""
    return found.rollup("check_type", "severity").agg(F.count("*").alias("n_findings"))


def issue_text() -> Column:
    """`[line] (issue) details`, without the parts that are missing."""
    return F.concat_ws(" ", F.when(F.col("line_no") > 0, F.concat(F.lit("[:"), F.col("line_no"), F.lit("]"))), F.when(F.col("issue") != "", F.concat(F.lit("("), F.col("issue"), F.lit(")"))), F.when(F.col("details") != "", F.col("details")).otherwise(F.col("matched_text")))


def markdown_reports(found: DataFrame, width: int = 150) -> DataFrame:
    """(doc_id, report): totals and, check by check, a Markdown table; bars are escaped before the cut at `width`."""
    cell = F.substring(F.replace("details", F.lit("|"), F.lit("\\|")), 1, width)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "severity", F.col("line_no").cast("string"), "issue", cell), F.lit(" |"))
    rows = found.select("doc_id", "check_type", "severity", F.struct(rank().alias("r"), "line_no", "issue", row.alias("row")).alias("x"))
    of = lambda s: F.count_if(F.col("severity") == s).alias(s)
    tables = rows.groupBy("doc_id", "check_type").agg(F.array_sort(F.collect_list("x")).alias("xs"), of("critical"), of("warning"), F.count("*").alias("n"))
    head = F.lit("| Severity | Line | Issue | Details |\n|---|---|---|---|\n")
    part = F.concat(F.lit("## "), F.col("check_type"), F.lit("\n\n"), head, F.array_join(F.transform("xs", lambda x: x["row"]), "\n"))
    grouped = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("check_type", part.alias("part")))).alias("parts"), F.sum("n").alias("n"), F.sum("critical").alias("c"), F.sum("warning").alias("w"))
    totals = F.concat(F.lit("# Integrity report\n\nFindings: "), F.col("n"), F.lit(", critical: "), F.col("c"), F.lit(", warnings: "), F.col("w"), F.lit("\n\n"))
    return grouped.select("doc_id", F.concat(totals, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")).alias("report"))


def printed_issues(found: DataFrame, width: int = 200, suggestions: int = 10, blocks: int | None = None) -> DataFrame:
    """(doc_id, severity, place, text): what a verdict prints, numbered by severity and cut at `width`.

    All critical findings and warnings, and the first `suggestions` of the
    others, after which a line says how many more there are. A document with
    many findings lies in several blocks.
    """
    keys, order = ["doc_id", "severity"], ["line_no", "issue", "matched_text", "details"]
    rows = in_blocks(found.filter(F.col("severity").isin(*SEVERITIES)), keys, order, blocks)
    some = numbered(rows, keys, order, "place").filter((F.col("severity") != "info") | (F.col("place") <= suggestions))
    more = rows.filter("severity = 'info'").groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > suggestions)
    rest = more.select(*keys, F.lit(suggestions + 1).cast("bigint").alias("place"), F.concat(F.lit("... and "), F.col("n") - suggestions, F.lit(" more.")).alias("text"))
    return some.select(*keys, F.col("place").cast("bigint").alias("place"), F.substring(issue_text(), 1, width).alias("text")).unionByName(rest)


def tool_output(found: DataFrame, major: int = 20, minor: int = 20, suggestions: int = 10) -> DataFrame:
    """(doc_id, json): the first issues of each severity as text, for tools that read JSON."""
    limits = dict(zip(SEVERITIES, (major, minor, suggestions), strict=True))
    order = Window.partitionBy("doc_id", "severity").orderBy("line_no", "issue", "matched_text", "details")
    few = _by_document(found).withColumn("place", F.row_number().over(order)).filter(F.coalesce(*[F.when(F.col("severity") == s, F.col("place") <= n) for s, n in limits.items()], F.lit(False)))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("place", issue_text().alias("text"))))), lambda x: x["text"]).alias(name) for s, name in zip(SEVERITIES, ("major_issues", "minor_issues", "suggestions"), strict=True)]
    return few.groupBy("doc_id").agg(*lists).select("doc_id", F.to_json(F.struct("major_issues", "minor_issues", "suggestions")).alias("json"))
