"""Hard negatives by rotated one-bit codes with interval filters and exact integer scores.

A vector is turned by a fixed random rotation (sign flips and Walsh-Hadamard steps) and stored as the
signs of its components, one bit each, with its length and its alignment: the cosine between the
turned vector and its code vector. For an anchor the inner product with a code vector is estimated by
population counts of the code against bit planes of the anchor's components. By Cauchy and Schwarz
the part of the vector beside its code vector adds at most the product of the two residual lengths,
so each pair has an interval that surely holds its score. Pairs whose interval cannot reach the
best ones or a window of scores are dropped; the others are scored as integers.

Anchors are a set of queries: they are sent to all tasks in blocks of bounded size, and every row is
compared with each block where it lies. A task returns only its best rows of each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.vector_codes import integers, usable
from chaffline.session import cut_lineage, spread

#: Integer components are stored in 32 bits.
MOST = 1 << 31
#: Bit planes of an anchor's components.
PLANES = 6
#: Rows and anchors that are compared at once.
ROWS_AT_ONCE = 2048
ANCHORS_AT_ONCE = 256
#: Bytes of the anchors that are sent to the tasks at once, about.
ANCHOR_BYTES = 32 << 20
#: Pairs of a block that are scored one by one where fewer survive than one in so many.
DENSE = 16
ROTATIONS = 3
SEED = 42

_LOW = np.iinfo(np.int64).min


def rotate(vectors: np.ndarray) -> np.ndarray:
    """The vectors, filled up to a power of two of at least 64 components, under the fixed rotation."""
    rows, size = vectors.shape
    width = max(64, 1 << max(size - 1, 0).bit_length())
    out = np.zeros((rows, width))
    out[:, :size] = vectors
    rng = np.random.default_rng(SEED)
    for _ in range(ROTATIONS):
        out *= rng.choice([-1.0, 1.0], width)
        half = 1
        while half < width:
            pairs = out.reshape(rows, -1, 2, half)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, width)
            half *= 2
        out /= np.sqrt(width)
    return out


@dataclass
class Coded:
    """Rows in tasks: keys, ids, labels, integer vectors, one-bit codes, lengths and alignments."""

    key: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    code: np.ndarray
    length: np.ndarray
    alignment: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> Coded:
        raw = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1)
        plain = lambda name: batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()
        return cls(
            plain("key"), plain("place"), plain("class"), raw("vector", "<i4").astype(np.int64), raw("code", "<u8"),
            plain("length"), plain("alignment"),
        )

    def take(self, rows) -> Coded:
        return Coded(*(getattr(self, f)[rows] for f in ("key", "vec_id", "label", "vector", "code", "length", "alignment")))


def code_vectors(vectors: DataFrame, scale: int, vec_id: str, label: str, vector: str) -> DataFrame:
    """The stored form of all rows that take part: key, place, class, vector and code of a row.

    `place` orders rows by id, null ids last; the key is a row's own, negative for a null id.
    """
    kept = spread(vectors.where(F.col(label).isNotNull() & usable(vector)), vec_id)
    whole = isinstance(kept.schema[label].dataType, T.IntegralType)
    number = F.monotonically_increasing_id()
    kept = kept.select(
        F.when(F.col(vec_id).isNull(), number - F.lit(1 << 62)).otherwise(number).alias("key"),
        F.coalesce(F.col(vec_id).cast("long"), F.lit((1 << 63) - 1)).alias("place"),
        (F.col(label).cast("long") if whole else F.xxhash64(label)).alias("class"),
        F.col(vector).alias("numbers"),
    )
    schema = T.StructType(kept.schema.fields[:-1]).add("vector", "binary").add("code", "binary")
    schema = schema.add("length", "double").add("alignment", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = integers(batch.column("numbers"), scale, MOST)
            turned = rotate(found)
            length = np.sqrt(np.square(found.astype(np.float64)).sum(1))
            codes = np.packbits(turned >= 0, axis=1, bitorder="little").view("<u8")
            code_part = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
            alignment = np.where(length > 0, np.minimum(code_part / np.where(length > 0, length, 1), 1), 1)
            rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], rows(found.astype("<i4")), rows(codes), pa.array(length), pa.array(alignment)],
                names=schema.names,
            )

    return kept.mapInArrow(run, schema)


class Estimator:
    """Intervals for the scores of some anchors with any rows, from codes alone."""

    def __init__(self, anchors: Coded):
        turned = rotate(anchors.vector)
        self.width = turned.shape[1]
        low = turned.min(1)
        self.step = (turned.max(1) - low) / ((1 << PLANES) - 1)
        safe = np.where(self.step > 0, self.step, 1)
        levels = np.rint((turned - low[:, None]) / safe[:, None]).astype(np.int64)
        rounded = low[:, None] + levels * self.step[:, None]
        self.low, self.total = low, rounded.sum(1)
        # What rounding to planes leaves out, and the length of the anchor.
        self.error = np.sqrt(np.square(turned - rounded).sum(1)) + 1e-9 * anchors.length
        self.length = anchors.length
        bits = (levels[:, None, :] >> np.arange(PLANES)[None, :, None]) & 1
        self.planes = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")

    def intervals(self, rows: Coded, anchors: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score of each of the anchors with each of the rows."""
        code = rows.code
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        counted = np.zeros((len(self.low[anchors]), len(code)))
        for plane in range(PLANES):
            own = self.planes[anchors, plane]
            for word in range(code.shape[1]):
                both = np.bitwise_count(own[:, word, None] & code[None, :, word])
                counted += both * float(1 << plane)
        # The anchor's inner product with the unit code vector: set bits count up, others down.
        counted *= self.step[anchors, None]
        counted += self.low[anchors, None] * ones
        along = (2 * counted - self.total[anchors, None]) / np.sqrt(self.width)
        error, length = self.error[anchors, None], self.length[anchors, None]
        aside = np.sqrt(np.maximum(np.square(length) - np.square(np.maximum(np.abs(along) - error, 0)), 0))
        beside = np.sqrt(np.maximum(1 - np.square(rows.alignment), 0))
        middle = along * (rows.length * rows.alignment)
        reach = error * (rows.length * rows.alignment) + aside * (rows.length * beside)
        reach += 1e-9 * length * rows.length + 1e-6
        return middle - reach, middle + reach


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of all anchors with all rows, exact."""
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    most = float(np.abs(anchors).max()) * float(np.abs(rows).max()) * anchors.shape[1]
    if most >= 2.0**63:
        raise ValueError("inner products beyond 63 bits")
    if most < 2.0**53:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors @ rows.T


def _surviving(anchors: Coded, rows: Coded, survivors: np.ndarray) -> np.ndarray:
    """Scores of the surviving pairs; other pairs may have any value."""
    left, right = np.nonzero(survivors)
    if len(left) * DENSE > survivors.size:
        return scores(anchors.vector, rows.vector)
    found = np.zeros(survivors.shape, np.int64)
    if len(left):
        scores(np.abs(anchors.vector).max(0, keepdims=True), np.abs(rows.vector).max(0, keepdims=True))
        found[left, right] = np.einsum("ij,ij->i", anchors.vector[left], rows.vector[right])
    return found


class Best:
    """The best rows of each slot so far: by score, then by id, then by key."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.least = np.full(slots, _LOW)  # what a row must reach to be among the best
        self.held = [np.zeros(0, np.int64)] * 4

    def add(self, slots: np.ndarray, found: np.ndarray, fine: np.ndarray, rows: Coded) -> None:
        """Offer the `fine` pairs of some slots and rows with their scores."""
        fine &= found >= self.least[slots, None]
        if fine.sum() > 4 * self.most * len(slots) and found.shape[1] > self.most:
            kept = np.where(fine, found, _LOW)
            fine &= found >= np.partition(kept, -self.most, axis=1)[:, -self.most, None]
        left, right = np.nonzero(fine)
        if not len(left):
            return
        new = [slots[left], found[left, right], rows.vec_id[right], rows.key[right]]
        slot, score, vec_id, key = (np.concatenate(x) for x in zip(self.held, new))
        order = np.lexsort((key, vec_id, -score, slot))
        slot, score, vec_id, key = (x[order] for x in (slot, score, vec_id, key))
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(first, append=len(slot)))
        keep = rank < self.most
        last = rank == self.most - 1
        self.least[slot[last]] = score[last]
        self.held = [x[keep] for x in (slot, score, vec_id, key)]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.held], ["slot", "score", "place", "key"])


_FOUND = "slot long, score long, place long, key long"
_FIELDS = ["key", "place", "class", "vector", "code", "length", "alignment"]


def _scan(rows: DataFrame, compare) -> DataFrame:
    """Compare all rows, block by block, where they lie; `compare` gives a function of blocks and what it found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, best = compare()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                look(Coded.of(batch.slice(at, ROWS_AT_ONCE)))
        yield best.batch()

    return rows.select(*_FIELDS).mapInArrow(run, _FOUND)


def _top(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each slot with their rank from 1; tasks cut their own rows first."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "place", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def positives(rows: DataFrame, anchors: Coded, most: int) -> DataFrame:
    """(slot, score, place, key, rank): the best other rows of each anchor's class.

    The slot is the anchor's number among `anchors`, which must be few enough to be sent to all tasks.
    """
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def compare():
        given = sent.value
        order = np.argsort(given.label, kind="stable")
        own = given.take(order)
        estimator, best = Estimator(own), Best(len(order), most)

        def look(block: Coded) -> None:
            by_class = np.argsort(block.label, kind="stable")
            block = block.take(by_class)
            names, first = np.unique(block.label, return_index=True)
            ends = np.append(first[1:], len(block.label))
            lows, highs = np.searchsorted(own.label, names), np.searchsorted(own.label, names, side="right")
            for a, b, low, high in zip(first, ends, lows, highs):
                rows_of = block.take(slice(a, b))
                for begin in range(low, high, ANCHORS_AT_ONCE):
                    part = slice(begin, min(begin + ANCHORS_AT_ONCE, high))
                    some = own.take(part)
                    other = some.key[:, None] != rows_of.key[None]
                    least, largest = estimator.intervals(rows_of, part)
                    slots = order[part]
                    needed = best.least[slots].astype(np.float64)
                    if b - a > most:  # as many rows surely score as much as that
                        sure = np.partition(np.where(other, least, -np.inf), -most, axis=1)[:, -most]
                        needed = np.maximum(needed, sure)
                    fine = other & (largest >= needed[:, None])
                    best.add(slots, _surviving(some, rows_of, fine), fine, rows_of)

        return look, best

    return _top(_scan(rows, compare), most)


def negatives(rows: DataFrame, anchors: Coded, asked: tuple[np.ndarray, ...], most: int) -> DataFrame:
    """(slot, score, place, key, rank): the best rows of other classes whose score lies in a window.

    `asked` are the anchor's number, the lowest and the highest score of each window; the slot is
    the window's number.
    """
    sent = rows.sparkSession.sparkContext.broadcast((anchors, asked))

    def compare():
        given, (numbers, low, high) = sent.value
        by_anchor = np.argsort(numbers, kind="stable")
        numbers, low, high = numbers[by_anchor], low[by_anchor], high[by_anchor]
        estimator, best = Estimator(given), Best(len(numbers), most)

        def look(block: Coded) -> None:
            for begin in range(0, len(given.key), ANCHORS_AT_ONCE):
                part = slice(begin, begin + ANCHORS_AT_ONCE)
                some = given.take(part)
                a, b = np.searchsorted(numbers, [begin, begin + len(some.key)])
                windows = np.arange(a, b)
                if not len(windows):
                    continue
                at = numbers[windows] - begin
                slots = by_anchor[windows]
                least, largest = estimator.intervals(block, part)
                other = some.label[:, None] != block.label[None]
                # The lowest score that any window of an anchor still takes, and the highest.
                needed = np.maximum(low[windows], best.least[slots])
                floor, roof = np.full(len(some.key), np.inf), np.full(len(some.key), -np.inf)
                np.minimum.at(floor, at, needed.astype(np.float64))
                np.maximum.at(roof, at, high[windows].astype(np.float64))
                survivors = other & (largest >= floor[:, None]) & (least <= roof[:, None])
                found = _surviving(some, block, survivors)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                number = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
                for turn in range(int(number.max()) + 1):
                    own = np.flatnonzero(number == turn)
                    which = at[own]
                    mine = found[which]
                    fine = survivors[which] & (mine >= low[windows[own], None]) & (mine <= high[windows[own], None])
                    best.add(slots[own], mine, fine, block)

        return look, best

    return _top(_scan(rows, compare), most)


def mine(
    vectors: DataFrame,
    every: int = 50,
    n_positives: int = 5,
    n_negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), a score is the inner product of the integers. Anchors are the
    rows whose id is divisible by `every`. An anchor's positives are its `n_positives` best other
    rows of its label; each has as negatives the `n_negatives` best rows of other labels with
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score. Ties go
    to the smaller id, then to the row that comes first in the table.

    Rows without a label or a usable vector (null, or with null, NaN or infinite components) take no
    part. Rows without an id are no anchors, but may be found; they come last in a tie. Repeated rows
    are rows of their own: a copy of an anchor may be its positive, and repeated anchors are answered
    each. Zero vectors score 0 with all. A positive with a negative score has no negatives. An anchor
    without positives or negatives, and an empty table, give no rows. Vectors must have one length;
    components beyond 2**31 after scaling fail with a message. Other columns are not read.

    The codes are written once and read twice for every block of anchors, a block being about
    `ANCHOR_BYTES`. On vectors without any structure the intervals are wide and most pairs are
    scored; on clustered ones they drop most.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(code_vectors(vectors, scale, vec_id, label, vector))
    chosen = rows.where((F.col("key") >= 0) & (F.col("place") % every == 0))
    count, size = chosen.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("vector")), F.lit(0))).first()
    # A block of about half the bound: ids are dealt by hash.
    blocks = -(-count * (size * 4 + 64) // (ANCHOR_BYTES // 2))
    found = []
    for block in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select(*_FIELDS).toArrow()
        if not own.num_rows:
            continue
        anchors = Coded.of(own)
        first = positives(rows, anchors, n_positives).toArrow()  # bounded by the block
        slot, score = (first.column(c).to_numpy() for c in ("slot", "score"))
        able = score >= 0
        low = -((-low_percent * score) // 100)
        high = (high_percent * score) // 100
        asked = slot[able], low[able], high[able]
        positive = pa.array(first.column("place").to_numpy()[able], mask=first.column("key").to_numpy()[able] < 0)
        pairs = pa.table(
            {
                "slot": np.arange(able.sum()), "anchor_id": anchors.vec_id[slot[able]], "positive_id": positive,
                "positive_score": score[able],
            }
        )
        best = negatives(rows, anchors, asked, n_negatives)
        answers = best.join(F.broadcast(spark.createDataFrame(pairs)), "slot").select(
            "anchor_id", "positive_id", "rank", F.when(F.col("key") >= 0, F.col("place")).alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
        found.append(cut_lineage(answers))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)
