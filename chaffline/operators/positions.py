"""Dense global positions without a one-task window.

`row_number()` over an unpartitioned window (or over one hot group) sorts everything in one
task. Here rows are range-partitioned and sorted, numbered inside their partition, and shifted
by the row counts of the partitions before them. Only the counts, one row per partition and
group, meet in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chaffline.session import broadcast_if_small, cut_lineage

# monotonically_increasing_id keeps the partition above, the row inside it below this bit.
_ROW_BITS = 33


def with_position(
    frame: DataFrame,
    order: Sequence[str | Column],
    within: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Add the 0-based position of each row by `order`, counted per group of `within`.

    `order` must end in a unique key, so that the position does not depend on the run. Keep
    `frame` narrow: it is shuffled once and checkpointed, because the cut points of a range
    partitioning are sampled and must not be drawn again between numbering and counting.
    """
    placed = with_running_total(frame, order, None, name, within)
    return placed


def with_running_total(
    frame: DataFrame,
    order: Sequence[str | Column],
    amount: str | None,
    name: str,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add the sum of `amount` over the rows before by `order`; without `amount`, their number.

    The same steps as for positions: totals meet in a window per partition, never the rows.
    """
    keys = [*within, *order]
    source = frame.persist(StorageLevel.MEMORY_AND_DISK)
    cut = source.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if amount is None:
        # The row's number in its partition; a group's first number is taken off below.
        own = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        numbered = cut.withColumn("_row", F.monotonically_increasing_id()).select(
            *frame.columns, F.shiftright("_row", _ROW_BITS).alias("_part"), own.alias("_at")
        )
    else:
        inside = (
            Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        )
        part = F.spark_partition_id().cast("long")
        numbered = cut.withColumn("_part", part).withColumn(
            "_at", F.coalesce(F.sum(amount).over(inside), F.lit(0))
        )
    numbered = cut_lineage(numbered)
    source.unpersist()

    total = F.count(F.lit(1)) if amount is None else F.coalesce(F.sum(amount), F.lit(0))
    counts = numbered.groupBy("_part", *within).agg(total.alias("_n"), F.min("_at").alias("_first"))
    before = (
        Window.partitionBy(*within)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counts.select(
        F.col("_part").alias("_shift_part"),
        *[F.col(c).alias(f"_shift_{c}") for c in within],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    # Without groups there is one row per partition; with groups the rows are counted first.
    shifts = broadcast_if_small(cut_lineage(shifts)) if within else F.broadcast(shifts)
    same = numbered["_part"] == shifts["_shift_part"]
    for column in within:
        same &= numbered[column].eqNullSafe(shifts[f"_shift_{column}"])
    return numbered.join(shifts, same).select(
        *[numbered[c] for c in frame.columns],
        (F.col("_at") + F.col("_shift")).cast("long").alias(name),
    )


def with_rank(
    scores: DataFrame, within: Sequence[str] = (), base: int = 0, name: str = "rank"
) -> DataFrame:
    """Rank by ascending (score, sample_id), NaN last, starting at `base`."""
    ranked = with_position(scores, ["score", "sample_id"], within, name)
    return ranked.withColumn(name, F.col(name) + F.lit(base)) if base else ranked
