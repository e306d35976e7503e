"""Compressed vectors: product quantisation whose nearest entries are found by Orchard's search.

A vector of integers is cut into equal parts, and each part is replaced by the index of the nearest
entry of that part's codebook. Orchard's search keeps, for every entry, the list of the other
entries by their distance from it. A search walks the list of its best entry so far, jumps to the
list of an entry that is nearer, marks what it has compared, and stops where the list is beyond twice
the distance it has: what lies there cannot be nearer. All arithmetic is on integers, so ties
and stops are exact. Codebooks are refined by rounds that read the vectors once each and shuffle
sums of parts only: one row for each entry and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.session import broadcast_if_small, cut_lineage

#: Integer components are below 2**27, so that distances and their sums stay exact.
MOST = 1 << 27


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def integers(column: pa.Array, scale: int, most: int = MOST) -> np.ndarray:
    """The vectors of a list column without nulls as floor(scale * x), one row each."""
    lengths = np.diff(np.asarray(column.offsets, dtype=np.int64))
    if not len(lengths):
        return np.zeros((0, 0), np.int64)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors must have one length")
    values = np.floor(np.asarray(column.flatten(), dtype=np.float64) * scale)
    if len(values) and np.abs(values).max() >= most:
        raise ValueError(f"a component times {scale} is beyond {most}")
    return values.astype(np.int64).reshape(len(lengths), int(lengths[0]))


@dataclass(frozen=True)
class Neighbours:
    """The entries of a codebook, and for each the others by distance from it, with those distances."""

    entries: np.ndarray
    order: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Neighbours:
        apart = np.square(entries[:, None] - entries[None]).sum(-1)
        np.fill_diagonal(apart, -1)  # an entry itself comes before its copies, and is left out
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        return cls(entries, order, np.take_along_axis(apart, order, 1))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each point, ties to the lower one, and the squared distance.

        All points are searched side by side, a step of each list at a time.
        """
        best = np.zeros(len(points), np.int64)
        distance = np.square(points - self.entries[0]).sum(1)
        seen = np.zeros((len(points), len(self.entries)), bool)
        seen[:, 0] = True
        at = np.zeros(len(points), np.int64)
        walking = np.arange(len(points) if len(self.entries) > 1 else 0)
        while len(walking):
            own, place = best[walking], at[walking]
            # Squared distances: twice as far is four times as much. Equal ones may be ties.
            reached = self.gaps[own, place] <= 4 * distance[walking]
            walking, own, place = walking[reached], own[reached], place[reached]
            entry = self.order[own, place]
            new = ~seen[walking, entry]
            asked, entry = walking[new], entry[new]
            seen[asked, entry] = True
            found = np.square(points[asked] - self.entries[entry]).sum(1)
            nearer = (found < distance[asked]) | ((found == distance[asked]) & (entry < best[asked]))
            at[walking] += 1
            jump = asked[nearer]
            best[jump], distance[jump], at[jump] = entry[nearer], found[nearer], 0
            walking = walking[at[walking] < self.order.shape[1]]
        return best, distance


@dataclass(frozen=True)
class Codebooks:
    """Codebooks by part position, each an array of (entries, width), and the scale of components."""

    books: tuple[np.ndarray, ...]
    scale: int

    def sha256(self) -> str:
        """Of all components as decimals by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, parts) and the squared distances summed over parts."""
        codes = np.zeros((len(vectors), len(self.books)), np.int64)
        errors = np.zeros(len(vectors), np.int64)
        at = 0
        for part, (book, lists) in enumerate(zip(self.books, self._lists())):
            width = book.shape[1]
            if at + width > vectors.shape[1]:
                raise ValueError("vectors must have one length")
            codes[:, part], distance = lists.nearest(vectors[:, at : at + width])
            errors += distance
            at += width
        if at != vectors.shape[1]:
            raise ValueError("vectors must have one length")
        return codes, errors

    def _lists(self) -> list[Neighbours]:
        return [Neighbours.of(book) for book in self.books]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (rows, parts) stand for."""
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1) / self.scale


def _refine(kept: DataFrame, books: Codebooks, vector: str) -> Codebooks:
    """A round: parts go to their nearest entries, entries move to the floors of their means."""
    size, width = books.books[0].shape
    parts = len(books.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts * size, width), np.int64)
        counts = np.zeros(parts * size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = integers(batch.column(0), books.scale)
            codes, _ = books.assign(points)
            slots = (codes + np.arange(parts) * size).ravel()
            # Sorted by entry, so that each entry's parts are summed in one stretch.
            order = np.argsort(slots, kind="stable")
            first = np.flatnonzero(np.diff(slots[order], prepend=-1))
            used = slots[order[first]]
            totals[used] += np.add.reduceat(points.reshape(-1, width)[order], first)
            counts += np.bincount(slots, minlength=len(counts))
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(totals[used].ravel())
        )
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists], ["slot", "n", "total"])

    sums = (
        kept.select(vector).mapInArrow(run, "slot long, n long, total array<long>")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
        .collect()  # a row per entry
    )
    found = np.concatenate(books.books)
    for row in sums:
        found[row.slot] = [x // row.n for x in row.total]
    return Codebooks(tuple(found.reshape(parts, size, width)), books.scale)


def fit_codebooks(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> Codebooks | None:
    """Codebooks from all usable vectors; None if there are none.

    They start as the parts of the `entries` smallest ids (null ids last, ties by components) and
    have fewer entries where there are fewer vectors. An entry without parts stays as it is.
    `vectors` is read once a round.
    """
    kept = vectors.where(usable(vector))
    first = kept.select(vec_id, vector).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).toArrow()
    if not first.num_rows:
        return None
    points = integers(first.column(1).combine_chunks(), scale)
    if not points.shape[1] or points.shape[1] % parts:
        raise ValueError(f"vectors of {points.shape[1]} components cannot be cut into {parts} equal parts")
    books = Codebooks(tuple(np.ascontiguousarray(p) for p in np.split(points, parts, axis=1)), scale)
    for _ in range(rounds):
        books = _refine(kept, books, vector)
    return books


def encode(
    vectors: DataFrame, books: Codebooks | None, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, label, codes, error) of every usable vector.

    Vectors that are null or have null, NaN or infinite components give no row. Null ids and
    labels are kept as they are, repeated rows have a row each. Vectors must have one length that
    the parts divide, and components below 2**27 after scaling; else the job fails with a message
    that says so. Without usable vectors the result is empty. Other columns are not read.
    """
    kept = vectors.where(usable(vector)).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    )
    schema = T.StructType(
        [*kept.schema.fields[:2], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = books.assign(integers(batch.column(2), books.scale))
            offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists, pa.array(errors)], ["vec_id", "label", "codes", "error"]
            )

    return kept.mapInArrow(run, schema)


def compress(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """(vec_id, label, codes, error, label_error, codebooks_sha256) of every usable vector.

    label_error is the error summed over all rows of the label, those without one together. The
    other cases are those of `fit_codebooks` and `encode`.
    """
    books = fit_codebooks(vectors, parts, entries, rounds, scale, vec_id, vector)
    coded = cut_lineage(encode(vectors, books, vec_id, label, vector))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    summed = coded.join(broadcast_if_small(cut_lineage(by_label)), F.col("label").eqNullSafe(F.col("_label")))
    sha = books.sha256() if books else None
    return summed.drop("_label").withColumn("codebooks_sha256", F.lit(sha).cast("string"))
