"""Toxicity categories by a classifier chain.

Categories are predicted one after another by linear models over the words of a document and their
beginnings, which words of one stem share; a later
model also sees the probabilities of the categories before it. In training those probabilities
are out-of-fold: a document's come from models that were fitted without its fold, so a later
model learns from predictions as good as those it will get. The models of a category are fitted by
tasks, one each, on a sample of labelled documents of at most `max_rows` rows; what they are applied to
is read whole. Where only one label is known, `with_kinds` makes the earlier categories from it: kinds
of its documents, which share words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.arrays import slices, texts_of, words_of
from chaffline.operators.logistic import Descent
from chaffline.session import cut_lineage

#: Labelled documents that the models are fitted on at most: those with the smallest hash of the id.
MAX_ROWS = 20_000
#: Lengths of the beginnings of longer words that count as words too, written with a star.
BEGINNINGS = (4, 5)
#: Chi-square a word must reach to be known, and documents of the sample that must have it.
LEAST_CHI_SQUARE = 20.0
LEAST_DOCUMENTS = 3
FOLDS = 3
#: Of a fit: penalty on squared weights, evaluations at most, and the slope that is flat enough.
PENALTY, EVALUATIONS, FLAT = 1e-4, 300, 1e-6
#: Rounds in which documents of a kind gather.
ROUNDS = 10
TEXT_BYTES = 8 << 20


@dataclass
class Linear:
    """A logistic model over known words and the probabilities of the categories before."""

    words: np.ndarray
    before: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray, columns: np.ndarray, count: int, before: np.ndarray) -> np.ndarray:
        found = np.bincount(rows, weights=self.words[columns], minlength=count)
        return found + before @ self.before + self.bias


@dataclass
class Chain:
    categories: list[str]
    vocabulary: list[str]
    models: list[Linear] = field(default_factory=list)
    #: Per category the probability from which on the out-of-fold predictions had the best F1.
    thresholds: list[float] = field(default_factory=list)

    def by_length(self) -> dict[int, tuple[pa.Array, np.ndarray]]:
        """The known beginnings of each length, words under 0, with their columns."""
        found: dict[int, list[tuple[str, int]]] = {n: [] for n in (0, *BEGINNINGS)}
        for column, word in enumerate(self.vocabulary):
            begun = word.endswith("*")
            found[len(word) - 1 if begun else 0].append((word.removesuffix("*"), column))
        return {
            n: (pa.array([w for w, _ in own], pa.string()), np.array([c for _, c in own], np.int64))
            for n, own in found.items()
        }

    def probabilities(self, rows: np.ndarray, columns: np.ndarray, count: int) -> np.ndarray:
        """By document and category; a (row, column) pair says that a document has a known word."""
        found = np.zeros((count, len(self.models)))
        for k, model in enumerate(self.models):
            found[:, k] = _sigmoid(model.logits(rows, columns, count, found[:, :k]))
        return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(
    rows: np.ndarray, columns: np.ndarray, width: int, before: np.ndarray, labels: np.ndarray, penalty: float = PENALTY
) -> Linear:
    """Logistic regression with a squared penalty on all weights but the bias, at its optimum."""
    count, extra = max(len(labels), 1), before.shape[1]
    share = (labels.sum() + 1) / (len(labels) + 2)
    start = np.zeros(width + extra + 1)
    start[-1] = np.log(share / (1 - share))
    state = Descent(start)
    for _ in range(EVALUATIONS):
        point = state.trial()
        model = Linear(point[:width], point[width:-1], float(point[-1]))
        logits = model.logits(rows, columns, len(labels), before)
        error = (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - labels) / count
        inner = point.copy()
        inner[-1] = 0
        value = (np.logaddexp(0, logits) - labels * logits).sum() / count + penalty / 2 * (inner @ inner)
        slope = np.concatenate((np.bincount(columns, weights=error[rows], minlength=width), error @ before, [error.sum()]))
        state.note(float(value), slope + penalty * inner, FLAT)
        if state.done:
            break
    return Linear(state.point[:width], state.point[width:-1], float(state.point[-1]))


def _fits(spark: SparkSession, data: tuple, before: np.ndarray, labels: np.ndarray) -> list[Linear]:
    """The model of a category without each fold, and that of all documents; a task each."""
    rows, columns, width, folds = data
    sent = spark.sparkContext.broadcast((data, before, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rows, columns, width, folds), before, labels = sent.value
        for batch in batches:
            for fold in batch.column(0).to_pylist():
                inside = folds != fold
                number, pairs = np.cumsum(inside) - 1, inside[rows]
                model = fit_linear(number[rows[pairs]], columns[pairs], width, before[inside], labels[inside])
                values = np.concatenate((model.words, model.before, [model.bias])).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([fold]), pa.array([values], pa.binary())], ["fold", "weights"])

    asked = spark.range(0, FOLDS + 1, 1, FOLDS + 1)
    found = asked.mapInArrow(run, "fold long, weights binary").orderBy("fold").toArrow()
    points = [np.frombuffer(w, np.float64) for w in found["weights"].to_pylist()]
    return [Linear(x[:width], x[width:-1], float(x[-1])) for x in points]


def fit_chain(
    spark: SparkSession, rows: np.ndarray, columns: np.ndarray, vocabulary: list[str], labels: np.ndarray,
    folds: np.ndarray, categories: Sequence[str],
) -> Chain:
    """Fit the chain to documents given as (row, column) pairs, labels by document and category."""
    count, width = len(labels), len(vocabulary)
    chain = Chain(list(categories), vocabulary)
    out_of_fold = np.zeros((count, len(categories)))
    for k in range(len(categories)):
        before = out_of_fold[:, :k].copy()
        *partial, whole = _fits(spark, (rows, columns, width, folds), before, labels[:, k])
        for fold, model in enumerate(partial):
            chances = _sigmoid(model.logits(rows, columns, count, before))
            out_of_fold[folds == fold, k] = chances[folds == fold]
        chain.models.append(whole)
        chain.thresholds.append(best_threshold(out_of_fold[:, k], labels[:, k]))
    return chain


def best_threshold(probabilities: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1, half-way to the next lower probability; 0.5 without positives."""
    if not labels.sum():
        return 0.5
    order = np.argsort(-probabilities, kind="stable")
    ranked = probabilities[order]
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    f1[:-1][ranked[1:] == ranked[:-1]] = -1.0  # equal probabilities are not told apart
    best = int(f1.argmax())
    return float((ranked[best] + (ranked[best + 1] if best + 1 < len(ranked) else 0.0)) / 2)


def distinct_words(documents: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns `keep` and `words`, the distinct words and beginnings of `text` (null as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            edges, words = words_of(texts_of(batch, "text"))
            plain = words.to_pylist()
            lists = []
            for a, b in zip(edges, edges[1:]):
                own = set(plain[a:b])
                begun = {w[:n] + "*" for n in BEGINNINGS for w in own if len(w) > n}
                lists.append(sorted(own | begun))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(lists, pa.list_(pa.string()))], [*keep, "words"]
            )

    chosen = documents.select(*keep, "text")
    fields = [f for f in chosen.schema.fields if f.name != "text"]
    return chosen.mapInArrow(run, T.StructType([*fields, T.StructField("words", T.ArrayType(T.StringType()))]))


def sample_of(labels: DataFrame, documents: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """The usable rows of labels with the smallest hashes of doc_id, at most `max_rows`, to be broadcast.

    Usable are those with a label of 0 or 1 whose id is among the documents. Labels are narrow, so
    the texts that belong to them are found by a scan and never shuffled.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return F.broadcast(cut_lineage(known.orderBy(F.xxhash64("doc_id"), *labels.columns).limit(max_rows)))


def _sample(labelled: DataFrame, categories: list[str], max_rows: int) -> DataFrame:
    """doc_id, the categories and the distinct words of usable rows, written."""
    usable = labelled.where(F.col("doc_id").isNotNull())
    for name in categories:
        usable = usable.where(F.col(name).isin(0, 1))
    ids = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct()
    return cut_lineage(distinct_words(usable.join(F.broadcast(ids), "doc_id"), ["doc_id", *categories]))


def _vocabulary(sample: DataFrame, categories: list[str]) -> list[str]:
    """The words that depend on a category; as many as the sample shows, which is bounded by its rows."""
    totals = sample.agg(F.count(F.lit(1)), *[F.sum(c) for c in categories]).first()
    with_word = [F.sum(c).alias(f"with_{i}") for i, c in enumerate(categories)]
    words = (
        sample.select(F.explode("words").alias("word"), *categories)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), *with_word)
        .where(F.col("n") >= LEAST_DOCUMENTS)
    )
    strength = []
    for i, total in enumerate(totals[1:]):
        expected = F.col("n") * F.lit(float(total or 0) / max(totals[0], 1))
        off = F.col(f"with_{i}") - expected
        strength.append(F.when(expected > 0, off * off / expected).otherwise(0.0))
    strong = words.where(F.greatest(*strength, F.lit(0.0)) >= LEAST_CHI_SQUARE)
    return sorted(r["word"] for r in strong.select("word").collect())


def _known_pairs(sample: DataFrame, vocabulary: list[str], columns: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The sample's rows by id, at most `max_rows`, and the (row, column) pairs of their known words."""
    names = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    rows = sample.select("doc_id", *columns, F.array_intersect("words", names).alias("words")).orderBy("doc_id", *columns).toArrow()
    lists = rows["words"].combine_chunks()
    flat = pc.index_in(lists.flatten(), value_set=pa.array(vocabulary, pa.string()))
    counts = np.diff(np.asarray(lists.offsets))
    return rows, np.repeat(np.arange(len(counts)), counts), np.asarray(flat, dtype=np.int64)


def kinds_of(rows: np.ndarray, columns: np.ndarray, count: int, width: int, kinds: int) -> np.ndarray:
    """The kind of each document by its known words: spherical means, begun far from each other."""
    sizes = np.bincount(rows, minlength=count)
    weight = 1 / np.sqrt(np.maximum(sizes, 1))[rows]
    centres = np.zeros((kinds, width))
    near = np.zeros(count)
    first = int(sizes.argmax())
    for k in range(kinds):
        own = rows == first
        centres[k, columns[own]] = weight[own]
        near = np.maximum(near, np.bincount(rows, weights=weight * centres[k, columns], minlength=count))
        first = int(np.where(sizes > 0, near, np.inf).argmin())
    found = np.zeros(count, np.int64)
    for _ in range(ROUNDS):
        close = np.stack([np.bincount(rows, weights=weight * c[columns], minlength=count) for c in centres])
        found = close.argmax(0)
        for k in range(kinds):
            own = found[rows] == k
            total = np.bincount(columns[own], weights=weight[own], minlength=width)
            centres[k] = total / max(np.sqrt(total @ total), 1e-300)
    return found


def with_kinds(labelled: DataFrame, label: str, kinds: int = 2, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows with columns kind_1, kind_2, ...: 1 where `label` is 1 and the document is of that kind.

    Kinds are found among the documents with the label, by the words that tell them from the others,
    on a sample of at most `max_rows` rows. Rows outside the sample or with another label have 0.
    """
    sample = _sample(labelled, [label], max_rows)
    vocabulary = _vocabulary(sample, [label])
    rows, row, column = _known_pairs(sample.where(F.col(label) == 1), vocabulary, [])
    found = kinds_of(row, column, len(rows), max(len(vocabulary), 1), kinds) if len(rows) else np.zeros(0, np.int64)
    table = pa.table({"doc_id": rows["doc_id"].combine_chunks(), "_kind": pa.array(found)})
    kind = labelled.sparkSession.createDataFrame(table).dropDuplicates(["doc_id"])
    joined = labelled.join(F.broadcast(kind), "doc_id", "left")
    own = [((F.col(label) == 1) & F.coalesce(F.col("_kind") == k, F.lit(False))).cast("int").alias(f"kind_{k + 1}") for k in range(kinds)]
    return joined.select(*labelled.columns, *own)


def fit(
    labelled: DataFrame, categories: Sequence[str], max_rows: int = MAX_ROWS, known_by: Sequence[str] | None = None
) -> Chain:
    """Fit a chain to rows with doc_id, text and a column of 0 or 1 for each category, in chain order.

    Rows with a null doc_id or label are left out; of more than `max_rows` rows those with the
    smallest hash of the id are taken. A word is known if it depends on one of the categories
    `known_by`, all unless given; kinds of a category need not be among them. Without rows every
    probability is one half.
    """
    categories = list(categories)
    sample = _sample(labelled, categories, max_rows)
    vocabulary = _vocabulary(sample, list(known_by or categories))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).alias("fold")
    rows, row, column = _known_pairs(sample.withColumn("fold", fold), vocabulary, [*categories, "fold"])
    if not rows.num_rows:
        models = [Linear(np.zeros(0), np.zeros(k), 0.0) for k in range(len(categories))]
        return Chain(categories, [], models, [0.5] * len(categories))
    labels = np.stack([np.asarray(rows[c], dtype=float) for c in categories], 1)
    return fit_chain(labelled.sparkSession, row, column, vocabulary, labels, np.asarray(rows["fold"]), categories)


def score(documents: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a probability for every category of the chain.

    Null and empty texts have no words and get the probabilities of the intercepts. Texts are read
    whole. Repeated rows and null ids stay as they are; an empty table gives no rows. Other columns
    are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        known = chain.by_length()
        for batch in slices(batches, text, TEXT_BYTES):
            edges, words = words_of(texts_of(batch, text))
            places, columns = [], []
            for length, (names, numbers) in known.items():
                asked = words
                if length:
                    long = np.flatnonzero(np.asarray(pc.utf8_length(words)) > length)
                    asked = pc.utf8_slice_codeunits(words.take(pa.array(long)), 0, length)
                found = pc.index_in(asked, value_set=names)
                place = np.flatnonzero(np.asarray(found.is_valid()))
                columns.append(numbers[np.asarray(found.take(pa.array(place)), dtype=np.int64)])
                places.append(long[place] if length else place)
            place, column = np.concatenate(places), np.concatenate(columns)
            row = np.searchsorted(edges, place, side="right") - 1
            pair = np.unique(row * max(len(chain.vocabulary), 1) + column)
            row, column = np.divmod(pair, max(len(chain.vocabulary), 1))
            found = chain.probabilities(row, column, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id), *(pa.array(found[:, k]) for k in range(len(chain.categories)))],
                ["doc_id", *chain.categories],
            )

    chosen = documents.select(doc_id, text)
    fields = [T.StructField("doc_id", chosen.schema[doc_id].dataType)]
    fields += [T.StructField(c, T.DoubleType()) for c in chain.categories]
    return chosen.mapInArrow(run, T.StructType(fields))
