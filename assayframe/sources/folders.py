"""Folders listed and read in parallel, empty files and folders included: what is listed is dealt anew before it is read, so that a folder of many files is read by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sinks.bundles import store

SCHEMA = "path string, bytes binary"


class _Folder(InputPartition):
    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


class _Reader(DataSourceReader):
    """The driver lists folders level by level until there are enough for ``tasks`` tasks, and no more than that; each task goes on below its own."""

    def __init__(self, path: str, tasks: int):
        self.path, self.tasks = path.rstrip("/"), tasks

    def partitions(self) -> list[_Folder]:
        fs, root = store(self.path)
        if fs.get_file_info(root).type != pafs.FileType.Directory:
            raise FileNotFoundError(self.path)
        level, seen = [root], []
        while level and len(level) < self.tasks:
            seen += level
            level = [x.path for f in level for x in fs.get_file_info(pafs.FileSelector(f)) if x.type == pafs.FileType.Directory]
        deal = lambda xs, deep: [_Folder(xs[k :: self.tasks], deep) for k in range(min(self.tasks, len(xs)))]
        return deal(seen, False) + deal(sorted(level), True)

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        fs, root = store(self.path)
        stack = list(partition.folders)
        names = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.nulls(len(names), pa.binary())], ["path", "bytes"])

        while stack:
            folder = stack.pop()
            if folder != root:
                names.append(folder[len(root) :].lstrip("/") + "/")
            for x in fs.get_file_info(pafs.FileSelector(folder)):
                if x.type == pafs.FileType.Directory:
                    stack += [x.path] * partition.deep
                elif x.type == pafs.FileType.File:
                    names.append(x.path[len(root) :].lstrip("/"))
                    if len(names) >= 10_000:
                        yield batch()
                        names = []
        if names:
            yield batch()


class Folders(DataSource):
    """The source ``folders`` with the options ``path`` and ``tasks``: the paths alone, ``bytes`` is null."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("tasks", "64")))


def _contents(path: str):
    """Of rows (path, bytes) the same with the bytes of files, in batches of about 8 MB."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(path)
        for batch in rows:
            names, data, size = [], [], 0
            for name in batch.column(0).to_pylist():
                names.append(name)
                if name.endswith("/"):
                    data.append(None)
                else:
                    with fs.open_input_stream(f"{root.rstrip('/')}/{name}") as f:
                        data.append(f.read())
                    size += len(data[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], ["path", "bytes"])
                    names, data, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], ["path", "bytes"])

    return each


def read_folders(spark: SparkSession, path: str, tasks: int | None = None, contents: bool = True) -> DataFrame:
    """(path relative to the folder, bytes) of all files under a folder that all executors share, empty ones too, and of all folders (ending in a slash, without bytes).

    Links and other special files are left out. A folder that isn't there is an error. One folder's listing is held at once.
    """
    spark.dataSource.register(Folders)
    tasks = tasks or spark.sparkContext.defaultParallelism
    listed = spark.read.format("folders").option("tasks", tasks).load(path)
    if not contents:
        return listed
    n = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(n, "path").mapInArrow(_contents(path.rstrip("/")), SCHEMA)
