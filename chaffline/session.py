"""Session helpers: where lineage is cut, and when a side is small enough to broadcast."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000
# A table is dealt out to all cores only up to this size.
SPREAD_BYTES = 256 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own if it names one.

    On a local master without a setting (tests) a new temporary folder is used; on a cluster
    a machine-local folder would be lost with its machine, so a missing setting is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="chaffline-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write `frame` to the reliable checkpoint folder and return the written rows."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def broadcast_if_small(frame: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when `frame` has at most `max_rows` rows, else leave the join to Spark.

    Only for narrow frames that are cheap to count (aggregates, checkpointed tables): the check
    reads at most `max_rows + 1` rows.
    """
    small = frame.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(frame) if small else frame


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Hash `frame` over all cores if it is small and comes in fewer partitions than there are cores.

    For a scan that feeds heavy work per row: a table in one file would keep one core busy. Only
    tables of up to `SPREAD_BYTES` by Spark's own estimate are moved; a larger one is read in
    splits of `spark.sql.files.maxPartitionBytes` and never shuffled for this.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = size <= SPREAD_BYTES and frame.rdd.getNumPartitions() < cores
    return frame.repartition(cores, key) if few else frame


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once.

    Not needed where it is installed on every machine.
    """
    context = spark.sparkContext
    if getattr(context, "_chaffline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="chaffline-package-")) / "chaffline.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._chaffline_shipped = True
