"""Tables in the folder that the whole cluster shares: intermediate ones, and ones kept by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset a local session, as in tests, gets a temporary folder; a cluster has none that all see."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows of one task where the work on a row is large beside its bytes, by which Spark would deal.
TASK_ROWS = 50_000


def dealt(df: DataFrame, key: Column, rows: int = TASK_ROWS) -> DataFrame:
    """df by key in partitions of about so many rows, however few bytes these have, so that tasks grow in number and not in length; df is counted, so it should be read from files."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows + 1)
    return df.repartition(n, key)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its rows and what names their partitions are settled, and lost executors cost nothing of it.

    Nothing tells when a frame that reads the table is done with, so the folder
    is left to whoever clears spark.checkpoint.dir.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
