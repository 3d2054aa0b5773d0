"""A stream whose events come out of order, against the batch operator."""

import random
from datetime import datetime, timedelta

from scriptorium.operators import registry
from scriptorium.streaming import audits


def test_late_events_are_taken_in_their_place(spark, tmp_path):
    rng = random.Random(8)
    at = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), at + timedelta(minutes=k // 2), k, rng.choices(["start", "complete", "verify", "fail"], (5, 5, 1, 1))[0]) for k in range(240)]
    late = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.randrange(50)))
    schema = "task_id long, ts timestamp, event_id long, event string"
    source = tmp_path / "in"
    source.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        end = [(99, at + timedelta(days=2), 999, "start")]
        for k in range(0, len(late), 60):
            spark.createDataFrame(late[k : k + 60], schema).coalesce(1).write.mode("append").parquet(str(source))
        query = audits.append_to(audits.task_evidence(stream), str(tmp_path / "out"), str(tmp_path / "check"))
        query.processAllAvailable()
        for more in (end, [(99, at + timedelta(days=3), 1000, "start")]):
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.event_id, r.task_id, r.to_state) for r in spark.read.parquet(str(tmp_path / "out")).filter("task_id <> 99").collect()]
    want = [(r.event_id, r.task_id, r.to_state) for r in registry.transitions(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(set(got))
