"""Files in the folder that the cluster's machines share, from Spark tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from chaffline.session import checkpoint_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, as a path or URI."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    store, path = locate(folder)
    store.create_dir(path, recursive=True)
    return folder


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write `frame` as a table of its own in the shared folder and return the written rows.

    Compressed and read by columns, where `cut_lineage` keeps whole rows; the files stay.
    """
    spark = frame.sparkSession
    path = f"{new_folder(spark, name)}/rows"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a path or URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def attempt_name(task: int, number: int, suffix: str) -> str:
    """A name no other attempt of the task takes; a manifest tells which attempt counts."""
    return f"part-{task:06d}-{number:05d}-{uuid.uuid4().hex[:8]}{suffix}"


def write_bytes(uri: str, data) -> None:
    store, path = locate(uri)
    with store.open_output_stream(path, compression=None) as sink:
        sink.write(data)


def read_bytes(uri: str) -> bytes:
    store, path = locate(uri)
    with store.open_input_file(path) as source:
        return source.read()
