"""Quality by a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of a text (shares, log counts, standardised).
Its covariance is shrunk towards the covariance of all classes and towards a multiple of the
identity, so that it has a Cholesky factor however few documents a class has. A score comes from the
difference of log densities: Mahalanobis distances by the cached factors, and log determinants.
Only sums of the statistics and of their products, per class, leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.arrays import LOWER_ASCII, slices, texts_of
from chaffline.session import cut_lineage

TEXT_BYTES = 8 << 20

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_PLAIN = b".,;:?'-\"()"
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS + _PLAIN)

STATISTICS = [
    "log_words", "word_length", "longest_word", "upper", "digits", "symbols", "plain_marks", "lines",
    "distinct_words", "repeated_neighbours", "distinct_lines", "marked_words", "upper_words", "common_word",
]


def _share(part: float, whole: float) -> float:
    """The square root of a share, which spreads out small ones."""
    return (part / whole) ** 0.5 if whole else 0.0


def statistics_of(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of STATISTICS; zeros for an empty one."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    size, count = len(data), len(words)
    without = [size - len(data.translate(None, kind)) for kind in (_UPPER, _DIGITS, _SYMBOLS, _PLAIN)]
    lowered = data.translate(LOWER_ASCII).split()
    distinct = len(set(lowered))
    lines = [x for x in data.split(b"\n") if x.strip()]
    marked = sum(1 for w in words if w[-1] in _SYMBOL_SET)
    upper = sum(map(bytes.isupper, words))
    sample = lowered if count < 3 else sorted(lowered)
    common = _longest_run(sample)
    return [
        float(np.log1p(count)),
        float(np.log(sum(map(len, words)) / count)),
        float(np.log(max(map(len, words)))),
        _share(without[0], size),
        _share(without[1], size),
        _share(without[2], size),
        _share(without[3], size),
        _share(len(lines), count),
        float(np.log(distinct) / np.log1p(count)),
        _share(sum(map(eq, lowered, lowered[1:])), count),
        len(set(lines)) / len(lines),
        _share(marked, count),
        _share(upper, count),
        _share(common, count),
    ]


_SYMBOL_SET = frozenset(_SYMBOLS)


def _longest_run(ordered: list[bytes]) -> int:
    from itertools import groupby

    return max(sum(1 for _ in run) for _, run in groupby(ordered))


def document_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, statistics) of every row. Null texts count as empty; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, TEXT_BYTES):
            rows = np.array([statistics_of(t) for t in texts_of(batch, text).to_pylist()]).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)), pa.array(rows))
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), lists], ["doc_id", "statistics"])

    chosen = documents.select(doc_id, text)
    kind = chosen.schema[doc_id].dataType
    return chosen.mapInArrow(
        run, T.StructType([T.StructField("doc_id", kind), T.StructField("statistics", T.ArrayType(T.DoubleType()))])
    )


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor, log density constant with the prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        z = (rows - self.centre) / self.scale
        logs = [
            c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant | None:
    """Fit to rows (statistics, label 0 or 1), all of them; None if there is none of either class.

    A class covariance is (1 - pooled) of its own and `pooled` of that of all classes, of which
    `ridge` is spread evenly over the diagonal. If one class has no rows, its mean and covariance are
    those of the other and only the priors, each class counting one row more, tell them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(STATISTICS)
        sums = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            rows = np.asarray(batch.column("statistics").flatten()).reshape(-1, width)
            labels = np.asarray(batch.column("label"))
            for k in (0, 1):
                own = rows[labels == k]
                sums[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["label", "sums"]
        )

    partial = labelled.select("statistics", "label").mapInArrow(run, "label int, sums array<double>")
    total = (
        partial.select("label", F.posexplode("sums").alias("at", "value"))
        .groupBy("label", "at")
        .agg(F.sum("value").alias("value"))
        .toArrow()  # two classes, a row for each sum
    )
    width = len(STATISTICS)
    sums = np.zeros((2, 1 + width + width * width))
    if total.num_rows:
        sums[np.asarray(total["label"]), np.asarray(total["at"])] = np.asarray(total["value"])
    return discriminant(sums, pooled, ridge)


def discriminant(sums: np.ndarray, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant | None:
    """The classifier from each class's count, sums and sums of products (see `fit`)."""
    width = len(STATISTICS)
    counts = sums[:, 0]
    if not counts.sum():
        return None
    all_sums = sums.sum(0)
    centre = all_sums[1 : 1 + width] / counts.sum()
    spread = all_sums[1 + width :].reshape(width, width) / counts.sum() - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 0))
    scale[scale < 1e-9] = 1.0
    means, covariances = np.zeros((2, width)), np.zeros((2, width, width))
    for k in (0, 1):
        n, own = (counts[k], sums[k]) if counts[k] else (counts.sum(), all_sums)
        mean = own[1 : 1 + width] / n
        products = own[1 + width :].reshape(width, width) / n - np.outer(mean, mean)
        means[k] = (mean - centre) / scale
        covariances[k] = products / np.outer(scale, scale)
    shared = np.einsum("k,kij->ij", counts / counts.sum(), covariances)
    factors, constants = [], []
    for k in (0, 1):
        mixed = (1 - pooled) * covariances[k] + pooled * shared
        mixed = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / width, 1e-3) * np.eye(width)
        factor = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(factor))
        constants.append(np.log((counts[k] + 1) / (counts.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, means, np.array(factors), np.array(constants))


def score(statistics: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score) for rows (doc_id, statistics); 0.5 where there is no model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("statistics").flatten()).reshape(-1, len(STATISTICS))
            found = np.full(len(rows), 0.5) if model is None else model.scores(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    kind = statistics.schema["doc_id"].dataType
    return statistics.select("doc_id", "statistics").mapInArrow(
        run, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    )


def classify_quality(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """doc_id and score (0 to 1, higher: class 1 likelier) of every document.

    `labels` has doc_id and a label of 0 or 1; all of its documents are used for the fit. Rows with
    a null id or label teach nothing, of repeated ones the smallest label counts. Null and
    empty texts have the statistics zero and a score like any other. Long texts are read whole.
    Without any label all scores are 0.5. An empty table gives no rows.
    """
    statistics = cut_lineage(document_statistics(documents, doc_id, text))
    known = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"))
    )
    return score(statistics, fit(statistics.join(known, "doc_id")))
