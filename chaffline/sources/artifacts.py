"""Tables passed between the steps: rankings, splits, subsets, run results, curves, conclusions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from chaffline.operators.curves import RUN_SCHEMA
from chaffline.operators.subsets import REMOVE_EASY, nested_subsets
from chaffline.scorers.base import RANKING_SCHEMA
from chaffline.session import broadcast_if_small, cut_lineage
from chaffline.sources.runs import run_files

SPLIT_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("split_seed", T.LongType()),
    ]
)
SUBSET_SCHEMA = T.StructType(
    [
        T.StructField("position", T.LongType()),
        T.StructField("sample_id", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("percent_removed", T.IntegerType()),
    ]
)
PLACE_SCHEMA = T.StructType(
    [T.StructField("place", T.LongType()), T.StructField("sample_id", T.LongType())]
    + [T.StructField("method", T.StringType()), T.StructField("direction", T.StringType())]
)
CUT_SCHEMA = T.StructType(
    [T.StructField("percent_removed", T.IntegerType()), T.StructField("cut", T.LongType()), T.StructField("n", T.LongType())]
    + [T.StructField("method", T.StringType()), T.StructField("direction", T.StringType())]
)
# Bytes of a row group of nested subsets: what a budget reads beyond its range at most.
ROW_GROUP_BYTES = 8 << 20
# Retained samples in one file of a subset.
ROWS_PER_FILE = 10_000_000
# A comma outside of quotes: an even number of quotes follows.
UNQUOTED_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# Names of an epoch metric, the preferred one first.
EPOCH_METRICS = ("val_acc_epoch", "val_acc"), ("val_loss_epoch", "val_loss")


def _holds_table(spark: SparkSession, path: str) -> bool:
    """Is there a parquet file below `path`? An empty folder, left by a failed write, holds none."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        return not files.select("path").isEmpty()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise


# Rankings ---------------------------------------------------------------------------------

def ranking_metadata(rankings: DataFrame, dataset: str, config: dict[str, Any]) -> DataFrame:
    """(method, dataset, num_samples, config): one row per method, config as JSON text."""
    text = json.dumps(config, separators=(",", ":"), sort_keys=True)
    return rankings.groupBy("method").agg(
        F.lit(dataset).alias("dataset"),
        F.count(F.lit(1)).alias("num_samples"),
        F.lit(text).alias("config"),
    )


def save_rankings(
    rankings: DataFrame, folder: str, dataset: str = "", config: dict[str, Any] | None = None
) -> None:
    """Parquet and CSV by method, and the metadata as JSON lines by method.

    Only the methods in `rankings` are written anew; what other methods have stored in the folder
    stays. The ranking is computed once and written from a checkpoint of its narrow rows.
    """
    rows = cut_lineage(rankings)
    _by_method(rows, "method").parquet(f"{folder}/scores")
    _by_method(rows, "method").csv(f"{folder}/scores_csv", header=True)
    _by_method(ranking_metadata(rows, dataset, config or {}), "method").json(f"{folder}/metadata")


def _by_method(rows: DataFrame, *keys: str) -> DataFrameWriter:
    """A writer that replaces the directories of the keys it is given rows of, and no others."""
    return rows.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic")


def read_rankings(spark: SparkSession, folder: str, method: str | None = None) -> DataFrame:
    """A saved ranking; a missing path or method is an error."""
    rankings = spark.read.schema(RANKING_SCHEMA).parquet(f"{folder}/scores")
    if method is None:
        return rankings
    chosen = rankings.filter(F.col("method") == method)
    if chosen.isEmpty():
        raise FileNotFoundError(f"no ranking by {method!r} under {folder}")
    return chosen


# Splits and subsets -------------------------------------------------------------------------

def load_or_create_split(spark: SparkSession, path: str, create, seed: int) -> DataFrame:
    """The stored split if there is one, whatever its seed; else `create(seed)`, stored.

    A folder without a parquet file is no stored split and is written anew.
    """
    if not _holds_table(spark, path):
        made = create(seed).withColumn("split_seed", F.lit(seed).cast("long"))
        made.write.mode("overwrite").parquet(path)
    return spark.read.schema(SPLIT_SCHEMA).parquet(path)


def save_subsets(subsets: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One directory per method and budget; `position` holds the order.

    A stretch of positions goes to one task, so a large budget is written by many tasks and a
    small one does not leave a file per task. Methods and budgets that are not in `subsets` stay.
    """
    stretch = F.call_function("div", F.col("position"), F.lit(rows_per_file))
    keys = ["method", "percent_removed"]
    dealt = subsets.repartition(*keys, stretch)
    _by_method(dealt, *keys).parquet(folder)


def read_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """Saved subsets; filters on method and budget read those directories only."""
    return spark.read.schema(SUBSET_SCHEMA).parquet(folder)


def save_nested_subsets(
    ranking: DataFrame,
    percentiles: Sequence[int],
    folder: str,
    direction: str = REMOVE_EASY,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """The subsets of all budgets stored once: samples in the order of their places, and the cuts.

    However many budgets there are, a sample is one row, and a budget a range of places, which row
    groups tell by their statistics. Other methods and directions in the folder stay.
    """
    rows, cuts = nested_subsets(ranking, percentiles, direction)
    keys = ["method", "direction"]
    placed = rows.repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "place")
    _by_method(placed, *keys).option("parquet.block.size", str(row_group_bytes)).parquet(f"{folder}/places")
    _by_method(cuts, *keys).parquet(f"{folder}/cuts")


def read_nested_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """(percent_removed, cut, n, method, direction): a row for each stored budget."""
    return spark.read.schema(CUT_SCHEMA).parquet(f"{folder}/cuts")


def read_nested_subset(
    spark: SparkSession, folder: str, method: str, percent_removed: int, direction: str = REMOVE_EASY
) -> DataFrame:
    """One budget as (method, percent_removed, position, sample_id); a budget not stored is an error.

    The range of places is part of the scan: files and row groups below the cut are not read.
    """
    own = (F.col("method") == method) & (F.col("direction") == direction)
    cut = read_nested_cuts(spark, folder).where(own & (F.col("percent_removed") == percent_removed)).first()
    if cut is None:
        raise FileNotFoundError(f"no subset by {method!r} at {percent_removed}% under {folder}")
    places = spark.read.schema(PLACE_SCHEMA).parquet(f"{folder}/places").where(own & (F.col("place") >= cut.cut))
    percent = F.lit(percent_removed).cast("int").alias("percent_removed")
    return places.select("method", percent, (F.col("place") - cut.cut).alias("position"), "sample_id")


def read_nested_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """All stored budgets as (method, direction, percent_removed, position, sample_id).

    A sample is repeated for the budgets that keep it; the cuts, a few rows, are broadcast.
    """
    places = spark.read.schema(PLACE_SCHEMA).parquet(f"{folder}/places")
    cuts = broadcast_if_small(read_nested_cuts(spark, folder))
    return places.join(cuts, ["method", "direction"]).where(F.col("place") >= F.col("cut")).select(
        "method", "direction", "percent_removed", (F.col("place") - F.col("cut")).alias("position"), "sample_id"
    )


def subset_manifest(subsets: DataFrame) -> DataFrame:
    """(method, percent_removed, path): the directory of every budget present."""
    return subsets.select("method", "percent_removed").distinct().withColumn(
        "path",
        F.format_string("method=%s/percent_removed=%s", "method", F.col("percent_removed").cast("string")),
    )


# Runs ---------------------------------------------------------------------------------------

def read_run_summaries(spark: SparkSession, root: str) -> DataFrame:
    """`<root>/<method>/pNN/seedS/run_summary.json`, one run each; no files give no rows.

    Read by the `run_summaries` source, hundreds of files a task.
    """
    return run_files(spark, root).select(*RUN_SCHEMA.names)


def append_runs(runs: DataFrame, path: str) -> None:
    """Add run results to a parquet table."""
    runs.select(*RUN_SCHEMA.names).write.mode("append").parquet(path)


def run_table(runs: DataFrame) -> DataFrame:
    """Run results in order of budget and seed."""
    return runs.select(*RUN_SCHEMA.names).orderBy("percent_removed", "seed", "method")


def save_run_table(runs: DataFrame, path: str) -> None:
    run_table(runs).write.mode("overwrite").csv(path, header=True)


def read_epoch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run, epoch, val_acc, val_loss) from sparse metric files, each under either column naming.

    `run` is the file's path. Every file has its own header, so one folder may mix namings and
    column orders. A column is taken from the `_epoch` name where a file has that. Cells in quotes may
    hold commas. The headers, a row per file, are broadcast if they are few; lines are not shuffled then.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("run"),
        F.transform(F.split("value", UNQUOTED_COMMA), lambda cell: F.trim(F.translate(cell, '"\r', ""))).alias("cells"),
    )
    is_header = F.array_contains("cells", "epoch")
    # One row per file. Files are alike in size, so no file is a hot key.
    headers = cut_lineage(lines.where(is_header).groupBy("run").agg(F.first("cells").alias("names")))
    rows = lines.where(~is_header).join(broadcast_if_small(headers), "run")

    def cell(*names: str):
        places = [F.array_position("names", n) for n in names]
        place = F.coalesce(*[F.when(p > 0, p) for p in places])
        return F.get("cells", place.cast("int") - 1)

    return rows.select(
        "run",
        cell("epoch").try_cast("long").alias("epoch"),
        *[cell(*names).try_cast("double").alias(names[-1]) for names in EPOCH_METRICS],
    )


# Curves and conclusions ---------------------------------------------------------------------

def save_curves(curves: DataFrame, folder: str) -> None:
    """The curve summary as CSV and as JSON records."""
    ordered = curves.orderBy("method", "percent_removed")
    ordered.write.mode("overwrite").csv(f"{folder}/curve_metrics_csv", header=True)
    ordered.write.mode("overwrite").json(f"{folder}/curve_metrics_json")


def save_fits(fits: DataFrame, folder: str) -> None:
    fits.orderBy("method").write.mode("overwrite").json(f"{folder}/scaling_law_fits")


def save_conclusions(lines: DataFrame, folder: str) -> None:
    """The conclusions as one text, lines in their order."""
    lines.orderBy("section", "ordinal").select("line").coalesce(1).write.mode("overwrite").text(
        f"{folder}/conclusions"
    )
