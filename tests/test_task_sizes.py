"""Work is dealt by rows, and done once."""

from pyspark.sql import functions as F

from scriptorium import tables
from scriptorium.operators import findings
from scriptorium.plans import catalogue


def test_tasks_grow_in_number(spark):
    rows = tables.stored(spark.range(4_000).withColumn("k", F.col("id") % 400))
    dealt = tables.dealt(rows, F.col("k"), 100).withColumn("p", F.spark_partition_id())
    assert dealt.select("p").distinct().count() > 30
    assert dealt.groupBy("k").agg(F.count_distinct("p").alias("n")).filter("n > 1").isEmpty() and dealt.count() == 4_000


def test_findings_of_runs_are_made_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(catalogue.history, "store", lambda found, *_: given.append(found))
    monkeypatch.setattr(catalogue.history, "findings_of", lambda *_: given[0])
    catalogue.run_findings(spark, "/root/testdata/sf0.001")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in given]
    assert len(plans) == 3 and not any("Generate" in p or "orders" in p for p in plans)


def test_tasks_sort_few_findings(spark, monkeypatch):
    monkeypatch.setattr(findings, "SORTED_ROWS", 100)
    rows = spark.range(4_000).select((F.col("id") % 400).alias("doc_id"), F.lit("info").alias("severity"), (F.col("id") / 400).cast("int").alias("line_no"), F.lit("a").alias("issue"), F.lit("").alias("matched_text"), F.lit("x").alias("details"))
    top = findings.top_findings(rows, 3)
    assert top.select(F.spark_partition_id().alias("p")).distinct().count() > 30
    assert top.count() == 1_200 and top.filter("place <> line_no + 1").isEmpty()
    assert findings.tool_output(rows).count() == 400
