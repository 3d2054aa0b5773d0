"""Runs and findings as append-only Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.findings import severity_counts
from scriptorium.sources.keyed import indexed


def runs_of(found: DataFrame, run_id: str, timestamp: str) -> DataFrame:
    """(run_id, timestamp, doc_id, check_type, n_critical, n_warning, n_info, n_findings): one run for each document and check."""
    return severity_counts(found, "doc_id", "check_type").select(F.lit(run_id).alias("run_id"), F.lit(timestamp).alias("timestamp"), "doc_id", "check_type", "n_critical", "n_warning", "n_info", "n_findings")


def store(found: DataFrame, folder: str, run_id: str, timestamp: str) -> None:
    """Append the findings of a run, and its counts. found is read twice: what is dear to find should be stored.

    A run's files have its id alone, so that their statistics and Bloom filters
    keep readers of other runs away; documents lie in them in order.
    """
    sorted_by = found.withColumn("run_id", F.lit(run_id)).sortWithinPartitions("check_type", "doc_id")
    sorted_by.write.mode("append").option("parquet.bloom.filter.enabled#run_id", "true").partitionBy("check_type").parquet(f"{folder}/findings")
    runs_of(found, run_id, timestamp).write.mode("append").parquet(f"{folder}/runs")


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """The findings of all runs in few files below another folder, in the order of runs, so that a run lies in one or two files."""
    indexed(spark.read.parquet(f"{folder}/findings"), ("run_id",)).partitionBy("check_type").parquet(f"{into}/findings")
    indexed(spark.read.parquet(f"{folder}/runs"), ("run_id",)).parquet(f"{into}/runs")


def history(runs: DataFrame, doc_id: int | None = None, check_type: str | None = None, limit: int = 20) -> DataFrame:
    """The newest runs, by timestamp text; equals by document and check."""
    if doc_id is not None:
        runs = runs.filter(F.col("doc_id") == doc_id)
    if check_type is not None:
        runs = runs.filter(F.col("check_type") == check_type)
    return runs.orderBy(F.desc("timestamp"), "doc_id", "check_type").limit(limit)


def findings_of(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """A run's findings by severity as text, so information stands before warnings, and line."""
    return spark.read.parquet(f"{folder}/findings").filter(F.col("run_id") == run_id).orderBy("severity", "line_no")
