"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a local session, as in tests, gets a temporary folder; a cluster has none that all see."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: While a table is written: partitions of the advised size, so that a small table becomes a file or two, not one for each core; and shuffle files go when it is done.
_WHILE_WRITING = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: it is computed once, and lost executors cost nothing of it."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = {key: spark.conf.get(key) for key in _WHILE_WRITING}
    try:
        for key, value in _WHILE_WRITING.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
