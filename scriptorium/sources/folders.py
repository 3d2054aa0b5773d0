"""A data source of whole text files: every file below a folder, whatever its name.

Spark's own readers pass over files whose names begin with an underscore or a
dot, and so over `__init__.py`. Here the driver lists names and sizes only; the
texts are read by partition where the tasks run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "scriptorium_text_files"
#: About so many bytes of text are read by one task; a larger file is one by itself.
PARTITION_BYTES = 32 << 20


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what goes before it in a file's name) of a path or URI that pyarrow knows."""
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path.split("://")[0] + "://" if "://" in path else "file://"
    return fs.LocalFileSystem(), path, "file://"


@dataclass
class Files(InputPartition):
    paths: list[str]


class TextFiles(DataSource):
    """file string, text string. Options: path; extensions, separated by commas, in any case; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, text string"

    def reader(self, schema) -> TextFilesReader:
        return TextFilesReader(self.options)


class TextFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.extensions = tuple(e.lower() for e in options.get("extensions", "").split(",") if e)
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        system, inner, _ = opened(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        out, held = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type != fs.FileType.File or self.extensions and not f.base_name.lower().endswith(self.extensions):
                continue
            if not out or held + f.size > self.bytes:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        system, _, prefix = opened(self.path)
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as stream:
                yield prefix + path, stream.read().decode("utf-8", "replace")


def text_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()):
    """(file, text) of all files below a path, or of the path itself; a missing one fails at once."""
    system, inner, _ = opened(path)
    if system.get_file_info(inner).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    spark.dataSource.register(TextFiles)
    return spark.read.format(NAME).options(path=path, extensions=",".join(extensions)).load()
