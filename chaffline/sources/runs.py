"""Run summaries: one small JSON file a run, thousands of them under one folder.

The source lists the folder once and plans tasks of hundreds of files each, so neither listing nor
reading has a task per file. A compacted table takes in what is new or changed since the last time;
its rows carry the path and time of their file, which is its manifest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.utils import AnalysisException

from chaffline.operators.curves import RUN_SCHEMA

#: Files that a task reads.
FILES_PER_TASK = 500
#: Place of a summary below the folder: <method>/pNN/seedS/run_summary.json.
PLACE = re.compile(r"[^/]+/p[^/]*/seed[^/]*/run_summary\.json")

FILE_SCHEMA = T.StructType([*RUN_SCHEMA.fields, T.StructField("path", T.StringType()), T.StructField("modified", T.TimestampType())])


def _locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_text(uri: str, text: str) -> None:
    """A small file, with the folders it lies in."""
    store, path = _locate(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as sink:
        sink.write(text.encode())


@dataclass
class Files(InputPartition):
    """Paths of a task's files below the root, and when they were modified."""

    found: list

    def __init__(self, found: list):
        self.found = found


class RunReader(DataSourceReader):
    def __init__(self, root: str, per_task: int):
        self.root, self.per_task = root.rstrip("/"), per_task

    def partitions(self) -> list[Files]:
        store, top = _locate(self.root)
        listed = store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        inside = ((i.path.removeprefix(top).lstrip("/"), i.mtime) for i in listed if i.type == fs.FileType.File)
        found = sorted(f for f in inside if PLACE.fullmatch(f[0]))
        parts = [Files(found[at : at + self.per_task]) for at in range(0, len(found), self.per_task)]
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, top = _locate(self.root)
        for path, modified in partition.found:
            with store.open_input_file(f"{top}/{path}") as file:
                try:
                    run = json.loads(file.read())
                except ValueError as broken:
                    raise ValueError(f"{self.root}/{path} is no run summary: {broken}") from broken
            yield (*(_typed(run.get(f.name), f.dataType) for f in RUN_SCHEMA), path, modified)


def _typed(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return str(value)
    return float(value) if isinstance(kind, T.DoubleType) else int(value)


class RunSummaries(DataSource):
    """`spark.read.format("run_summaries").load(root)`; option `filesPerTask`."""

    @classmethod
    def name(cls) -> str:
        return "run_summaries"

    def schema(self) -> T.StructType:
        return FILE_SCHEMA

    def reader(self, schema: T.StructType) -> RunReader:
        return RunReader(self.options["path"], int(self.options.get("filesPerTask", FILES_PER_TASK)))


def run_files(spark: SparkSession, root: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """(*run, path, modified) of every summary below `root`; a missing folder has none."""
    spark.dataSource.register(RunSummaries)
    return spark.read.format("run_summaries").option("filesPerTask", str(files_per_task)).load(root)


def compact_runs(spark: SparkSession, root: str, table: str) -> int:
    """Take the summaries that are new or changed into a compacted table; returns how many.

    A file is known by its path and time. Of a changed one the newest row counts when the table is
    read, so nothing is rewritten.
    """
    new = run_files(spark, root)
    known = _table(spark, table)
    if known is not None:
        new = new.join(known.select("path", "modified"), ["path", "modified"], "left_anti").select(*FILE_SCHEMA.names)
    new = new.persist()
    try:
        count = new.count()
        if count:
            new.coalesce(max(1, count // 1_000_000)).write.mode("append").parquet(table)
        return count
    finally:
        new.unpersist()


def compacted_runs(spark: SparkSession, table: str) -> DataFrame:
    """The runs of a compacted table, each as its file was last taken in; no table gives no rows."""
    known = _table(spark, table)
    if known is None:
        return spark.createDataFrame([], RUN_SCHEMA)
    run = F.max_by(F.struct(*RUN_SCHEMA.names), "modified").alias("run")
    return known.groupBy("path").agg(run).select("run.*")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(FILE_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise
