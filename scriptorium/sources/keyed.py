"""Tables kept by key in a folder: versions of Parquet files, and a pointer to the one that counts.

A version is written whole under a name of its own and becomes the table when
the pointer is replaced, by one rename. A writer that fails leaves the last
version as it was, and readers of it keep their files: versions stay until they
are dropped.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "CURRENT"


@dataclass
class KeyedTable:
    """A table with one row for each key. defaults: columns that begin anew, with these SQL values, whenever their row is replaced."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    defaults: dict[str, str]

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> str | None:
        """The name of the version that counts; None before the first."""
        system, path = self._fs(_POINTER)
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _point_to(self, version: str) -> None:
        system, new = self._fs(f"{_POINTER}.{version}")
        stream = system.create(new, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, self._fs(_POINTER)[1], options)

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"no table in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{version}")

    def replace(self, rows: DataFrame, order: Column | None = None) -> None:
        """Put rows in place of those with the same key, and beside all others.

        Columns of defaults get their values; of several rows with one key the
        last by `order` counts, of equals the one that is last as JSON. Null keys
        are keys. The version is dealt and sorted by key, so that a query for
        some keys reads few row groups.
        """
        fresh = rows.withColumns({c: F.expr(sql) for c, sql in self.defaults.items()})
        ranked = F.struct(*([order] if order is not None else []), F.to_json(F.struct(*[F.col(c) for c in rows.columns])))
        whole = F.struct(*fresh.columns)
        fresh = fresh.groupBy(*self.keys).agg(F.max_by(whole, ranked).alias("_row")).select("_row.*")
        table = fresh
        if self.version() is not None:
            old = self.read()
            its = fresh.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
            same = F.lit(True)
            for k in self.keys:
                same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
            table = old.join(its, same, "left_anti").unionByName(fresh, allowMissingColumns=True)
        self._write(table)

    def update(self, changes: DataFrame) -> None:
        """Set the columns that changes(*keys, ...) has for the keys that the table has; other columns and keys stay."""
        its = changes.select(*self.keys, F.struct(*[c for c in changes.columns if c not in self.keys]).alias("_new"))
        met = self.read().join(its, list(self.keys), "left")
        changed = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in changes.columns if c not in self.keys}
        self._write(met.withColumns(changed).drop("_new"))

    def _write(self, table: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        indexed(table, self.keys).parquet(f"{self.folder}/{version}")
        self._point_to(version)

    def drop_others(self) -> None:
        """Delete all versions but the one that counts; for when no reader of an older one is left."""
        now = self.version()
        system, folder = self._fs("")
        for status in system.listStatus(folder):
            if status.getPath().getName().startswith("v-") and status.getPath().getName() != now:
                system.delete(status.getPath(), True)


def indexed(table: DataFrame, keys: tuple[str, ...], mode: str = "errorifexists"):
    """A writer of rows in the order of keys, in files that overlap in no key but those at their ends, with Bloom filters on the keys."""
    writer = table.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    return writer

