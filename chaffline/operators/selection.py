"""Exact order statistics without a sort: histograms that are refined where the wanted ranks lie.

A pass counts the values of an interval in buckets and keeps each bucket's smallest and largest
value. The bucket that holds a wanted rank is the next interval, from its smallest to its largest
value, so an interval always splits until it holds one value. Buckets are equal in value, or in
the logarithm where an interval spans several powers of two, and first of all told apart by sign;
so few passes are needed at any size and spread. Nothing is shuffled but bucket counts, added up by
each task first.
Groups and ranks take their passes side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chaffline.session import broadcast_if_small, cut_lineage

#: Buckets of an interval.
BUCKETS = 1024
#: Values that the driver takes at most.
FEW = 1 << 18
#: Ratio of an interval's ends from which on buckets are equal in the logarithm.
WIDE = 8.0


def _bucket():
    """The bucket of _v in [_low, _high]; it never falls where _v grows (nor does the logarithm)."""
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    # Halves first: the width of an interval of finite numbers may not be one.
    linear = (v / 2 - low / 2) / (high / 2 - low / 2)
    rising = (F.ln(v) - F.ln(low)) / (F.ln(high) - F.ln(low))
    falling = (F.ln(-low) - F.ln(-v)) / (F.ln(-low) - F.ln(-high))
    share = F.when((low > 0) & (low < high / WIDE), rising).when((high < 0) & (high > low / WIDE), falling).otherwise(linear)
    inside = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    return F.when((low <= 0) & (high >= 0), F.signum(v).cast("long")).otherwise(inside)


def select_ranks(values: DataFrame, column: str, ranks: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(*within, rank, value): for each wanted rank, from 0 by value ascending, the value there.

    `ranks` has the columns `within` and `rank`. Ranks beyond a group's rows, and groups without
    rows, give none. Null, NaN and infinite values do not count. `values` is read once a pass and should be
    written or cheap.
    """
    keys = list(within)
    value = F.col(column).cast("double")
    held = values.select(*keys, value.alias("_v")).where(F.abs("_v") < F.lit(float("inf")))
    ends = held.groupBy(*keys).agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n")
    )
    wanted = ranks.select(*keys, F.col("rank").cast("long").alias("rank")).distinct()
    joined = wanted.join(ends, keys) if keys else wanted.crossJoin(F.broadcast(ends))  # one row of ends
    open_ranks = cut_lineage(
        joined.where((F.col("rank") >= 0) & (F.col("rank") < F.col("_n"))).select(
            *keys, "rank", F.col("rank").alias("_at"), "_low", "_high"
        )
    )
    found = open_ranks.where("_low = _high").select(*keys, "rank", F.col("_low").alias("value"))
    open_ranks = open_ranks.where("_low < _high")
    interval = [*keys, "_low", "_high"]
    while not open_ranks.isEmpty():
        asked = broadcast_if_small(open_ranks.select(*interval).distinct())
        rows = held.join(asked, keys) if keys else held.crossJoin(F.broadcast(asked))  # an interval a rank at most
        counts = (
            rows.where(F.col("_v").between(F.col("_low"), F.col("_high")))
            .groupBy(*interval, _bucket().alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        )
        # At most BUCKETS rows in a window.
        before = Window.partitionBy(*interval).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        place = F.col("_at") - F.col("_before")
        narrowed = cut_lineage(
            counts.join(open_ranks, interval)
            .where((place >= 0) & (place < F.col("_n")))
            .select(*keys, "rank", place.alias("_at"), F.col("_first").alias("_low"), F.col("_last").alias("_high"))
        )
        found = found.unionByName(narrowed.where("_low = _high").select(*keys, "rank", F.col("_low").alias("value")))
        open_ranks = narrowed.where("_low < _high")
    return found


def quantiles(values: DataFrame, column: str, shares: Sequence[float], within: Sequence[str] = ()) -> DataFrame:
    """(*within, q0, q1, ...): quantiles interpolated between the two nearest values.

    A table of at most `FEW` values without groups is measured on the driver.
    """
    keys = list(within)
    known = values.where(F.abs(F.col(column).cast("double")) < F.lit(float("inf")))
    if not keys:
        few = known.select(F.col(column).cast("double").alias("v")).limit(FEW + 1).toArrow()["v"].to_numpy()
        if len(few) <= FEW:
            row = [tuple(float(q) for q in np.quantile(few, list(shares)))] if len(few) else []
            return values.sparkSession.createDataFrame(row, ", ".join(f"q{i} double" for i in range(len(shares))))
    sizes = cut_lineage(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0"))
    place = lambda share: (F.col("_n") - 1) * F.lit(float(share))
    wanted = F.array(*[F.floor(place(s)) for s in shares], *[F.least(F.floor(place(s)) + 1, F.col("_n") - 1) for s in shares])
    ranks = sizes.select(*keys, F.explode(wanted).alias("rank"))
    found = select_ranks(known, column, ranks, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_values")
    )
    joined = sizes.join(found, keys) if keys else sizes.crossJoin(F.broadcast(found))  # one row each
    out = []
    for i, share in enumerate(shares):
        below = F.floor(place(share))
        low, high = (F.element_at("_values", r) for r in (below, F.least(below + 1, F.col("_n") - 1)))
        out.append((low + (high - low) * (place(share) - below)).alias(f"q{i}"))
    return joined.select(*keys, *out)
