"""Seeded order keys and row-count scalars shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded_key(seed: int, *columns: str) -> Column:
    """A pseudo-random sort key that depends on the seed and the row's id only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def row_count(frame: DataFrame) -> Column:
    """The number of rows of `frame` as a scalar subquery."""
    return frame.agg(F.count(F.lit(1))).scalar()
