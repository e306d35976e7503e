"""Text sources: (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table with `doc_id` and `text`; no other column is read."""
    return spark.read.parquet(path).select("doc_id", "text")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 files, one document each; the id follows from the file's path."""
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("text"),
    )
