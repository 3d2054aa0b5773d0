"""Outputs of scripts beside the manuscripts that name them, and beside their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.findings import finding, together
from scriptorium.operators.numbers import OUTPUT_NUMBER, nearest, output_discrepancies, output_numbers, table_numbers


def _state(output_numbers_severity: str) -> Column:
    """What is wrong with an output as a whole, as (severity, issue, details); null if there are numbers to compare."""
    of = lambda severity, issue, details: F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), details.alias("details"))
    code = F.coalesce(F.col("exit_code").cast("string"), F.lit("none"))
    return (
        F.when(F.col("exit_code").isNull() | (F.col("exit_code") != 0), of("critical", "script_failed", F.concat(F.lit("return code "), code, F.lit(": "), F.substring(F.coalesce("stderr", F.lit("")), 1, 200))))
        .when(~F.coalesce("stdout", F.lit("")).rlike(r"\S"), of("warning", "no_output", F.lit("")))
        .when(~F.col("stdout").rlike(OUTPUT_NUMBER), of(output_numbers_severity, "no_numbers_in_output", F.lit("")))
    )


def reproducibility(lines: DataFrame, references: DataFrame, outputs: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Findings on references(doc_id, line_no, script, path) to scripts with outputs(doc_id, script, exit_code, stdout, stderr).

    A script of a path is one that was found; of these, one without an output
    has failed. Output numbers are held against all numbers of the manuscript.
    """
    known = references.filter("path is not null").select("doc_id", "line_no", "script")
    met = known.join(outputs, ["doc_id", "script"], "left").withColumn("state", _state("info"))
    check = "reproducibility"
    without = lines.select("doc_id").distinct().join(known.select("doc_id").distinct(), "doc_id", "left_anti")
    text = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(OUTPUT_NUMBER), F.lit(0))).alias("raw")).select("doc_id", F.expr("try_cast(raw as double)").alias("value"))
    shown = output_numbers(met.filter("state is null").select("doc_id", F.struct("line_no", "script").alias("script"), "stdout"))
    far = output_discrepancies(shown.select("doc_id", "script", "raw", "value"), text.filter("value is not null"), threshold)
    whole = met.filter("state is not null").select("doc_id", "line_no", "script", "state.*")
    return together(
        [
            finding(without, check, "no_scripts_found", "info", line=F.lit(0)),
            finding(whole, check, F.col("issue"), F.col("severity"), matched=F.col("script"), details=F.col("details")),
            finding(far.withColumn("line_no", F.col("script.line_no")), check, "number_discrepancy", F.col("severity"), matched=F.col("raw"), details=F.format_string("%s, paper %s: %.2f %%", "raw", F.col("nearest").cast("string"), F.col("rel_diff") * 100)),
        ]
    )


def verified_numbers(docs: DataFrame, outputs: DataFrame, warning: float = 0.05, critical: float = 0.20) -> DataFrame:
    """Findings on the numbers in tables of docs(doc_id, text) against each document's outputs(doc_id, script, exit_code, stdout, stderr).

    Without tables nothing else is looked at, and with a bad output nothing is
    compared. The summary counts the numbers that have a near one and those
    that differ too much.
    """
    check = "verify_numbers"
    tables = table_numbers(docs)
    parsed = tables.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("table_index").alias("n_tables"))
    none = docs.select("doc_id").distinct().join(parsed, "doc_id", "left_anti")
    met = parsed.join(outputs, "doc_id").withColumn("state", _state("warning"))
    good = met.filter("state is null")
    shown = output_numbers(good.select("doc_id", "script", "stdout"))
    n_shown = shown.groupBy("doc_id").agg(F.count("*").alias("n_shown"))
    near = nearest(tables.join(good.select("doc_id"), "doc_id", "left_semi"), shown.select("doc_id", "value"), ["doc_id"]).filter("rel_diff <= 0.5")
    near = near.withColumn("severity", F.when(F.col("rel_diff") > critical, "critical").when(F.col("rel_diff") > warning, "warning"))
    counts = near.groupBy("doc_id").agg(F.count("*").alias("n_matched"), F.count("severity").alias("n_apart"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    summary = good.select("doc_id").join(counts, "doc_id", "left")
    none_line = F.lit(0)
    return together(
        [
            finding(none, check, "no_tables_found", "info", line=none_line),
            finding(parsed, check, "tables_parsed", "info", line=none_line, details=F.format_string("%d numbers, %d tables", "n", "n_tables")),
            finding(met.filter("state is not null").select("doc_id", "script", "state.*"), check, F.col("issue"), F.col("severity"), line=none_line, matched=F.col("script"), details=F.col("details")),
            finding(n_shown, check, "output_parsed", "info", line=none_line, details=F.format_string("%d numbers", "n_shown")),
            finding(near.filter("severity is not null"), check, "table_code_mismatch", F.col("severity"), matched=F.col("raw"), details=F.format_string("table %d, script %s: %.1f %%", F.col("table_index") + 1, F.col("nearest").cast("string"), F.col("rel_diff") * 100)),
            finding(summary, check, "verification_summary", "info", line=none_line, details=F.concat(count("n_matched"), F.lit(" matched, "), count("n_apart"), F.lit(" apart"))),
        ]
    )
