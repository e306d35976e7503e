"""Scores from a language model's outputs, and a counted stand-in for such a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaffline.functions import vectors
from chaffline.functions.text import characters
from chaffline.scorers.base import carried
from chaffline.session import cut_lineage

# Pairs of a counted model that are sent to every task at most: 64 MB of arrays.
MODEL_PAIRS = 4_000_000
# Bits of a code point.
_CODE_BITS = 21
_LAST_CODE = (1 << _CODE_BITS) - 1


def _label(tokens: DataFrame) -> list[Column]:
    """A sample's label from its token rows, which all hold the same."""
    return [F.max(c).alias(c) for c in carried(tokens)]


def perplexity_scores(losses: DataFrame, digits: int = 6) -> DataFrame:
    """exp(mean token loss) per sample.

    The sum's last bits depend on the order of the rows, so the score is rounded before it is
    ranked. With a column `n` a row stands for n tokens of the same loss.
    """
    n = F.col("n") if "n" in losses.columns else F.lit(1)
    mean = F.sum(F.col("loss") * n) / F.sum(n)
    return losses.groupBy("sample_id").agg(
        F.round(F.exp(mean), digits).alias("score"), *_label(losses)
    )


def entropy_scores(distributions: DataFrame, digits: int = 6) -> DataFrame:
    """Mean prediction entropy per sample over its token distributions (`probs`)."""
    entropy = vectors.entropy(F.col("probs")).alias("entropy")
    return (
        distributions.select("sample_id", *carried(distributions), entropy)
        .groupBy("sample_id")
        .agg(F.round(F.avg("entropy"), digits).alias("score"), *_label(distributions))
    )


def distributions_from_logits(logits: DataFrame) -> DataFrame:
    """(sample_id, probs): softmax of each row's logits."""
    return logits.select("sample_id", vectors.softmax(F.col("logits")).alias("probs"))


def _code_points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Context and next character of every pair in a batch's chunks as one code, and its chunk."""
    chunks = batch.column("chunk").to_pylist()
    sizes = np.fromiter((len(c or "") for c in chunks), np.int64, len(chunks))
    codes = np.frombuffer("".join(c or "" for c in chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(chunks)), sizes)
    inside = owner[1:] == owner[:-1]
    return ((codes[:-1] << _CODE_BITS) | codes[1:])[inside], owner[1:][inside]


def fit_bigrams(chunks: DataFrame, vocabulary_size: int) -> DataFrame:
    """(context, next, n, context_n, loss): counts and the add-one smoothed loss of every seen pair.

    Pairs are counted per Arrow batch, so counts are shuffled and never characters. The context
    total is a second, small aggregate of the pair counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = np.unique(_code_points(batch)[0], return_counts=True)
            letters = [[chr(c) for c in part] for part in (codes >> _CODE_BITS, codes & _LAST_CODE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(letters[0], pa.string()), pa.array(letters[1], pa.string()), pa.array(counts, pa.int64())],
                names=["context", "next", "n"],
            )

    counted = chunks.select("chunk").mapInArrow(count, "context string, next string, n long")
    pairs = cut_lineage(counted.groupBy("context", "next").agg(F.sum("n").alias("n")))
    totals = pairs.groupBy("context").agg(F.sum("n").alias("context_n"))
    probability = (F.col("n") + 1) / (F.col("context_n") + F.lit(vocabulary_size))
    return cut_lineage(
        pairs.join(totals, "context").select(
            "context", "next", "n", "context_n", (-F.log(probability)).alias("loss")
        )
    )


def chunk_token_losses(chunks: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, losses, first_target): a chunk's losses in token order, one row per chunk.

    `first_target` is the code point of the second character; a chunk of one character has no
    losses and no target. The model must have been fitted on these chunks. One of up to
    `MODEL_PAIRS` pairs (16 bytes each) is sent to the tasks as sorted arrays and no row is
    shuffled; a larger one meets the distinct pairs of each chunk in a join.
    """
    if model.limit(MODEL_PAIRS + 1).count() > MODEL_PAIRS:
        return _joined_losses(chunks, model, keys)
    code = F.shiftleft(F.ascii("context").cast("long"), _CODE_BITS).bitwiseOR(F.ascii("next").cast("long"))
    table = model.select(code.alias("code"), "loss").toArrow()
    codes, losses = table["code"].to_numpy(), table["loss"].to_numpy()
    order = np.argsort(codes)
    shared = chunks.sparkSession.sparkContext.broadcast((codes[order], losses[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        for batch in batches:
            pairs, owner = _code_points(batch)
            own = values[np.searchsorted(known, pairs)]
            ends = np.searchsorted(owner, np.arange(batch.num_rows), side="right")
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            has = offsets[1:] > offsets[:-1]
            firsts = np.zeros(batch.num_rows, np.int32)
            firsts[has] = pairs[offsets[:-1][has]] & _LAST_CODE
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keys),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(own)),
                    pa.array(firsts, mask=~has),
                ],
                names=[*keys, "losses", "first_target"],
            )

    chosen = chunks.select(*keys, "chunk")
    fields = [f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys]
    return chosen.mapInArrow(look_up, ", ".join([*fields, "losses array<double>", "first_target int"]))


def _joined_losses(chunks: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """The same for any model: each chunk's distinct pairs, with their places, are joined."""
    letters = characters(F.col("chunk"))
    size = F.size("_ch")
    pair = F.arrays_zip(
        F.slice("_ch", F.lit(1), size - 1).alias("context"), F.slice("_ch", F.lit(2), size - 1).alias("next")
    )
    rows = chunks.select(*keys, letters.alias("_ch"))
    pairs = (
        rows.where(size > 1)
        .select(*keys, F.posexplode(pair).alias("_at", "_pair"))
        .groupBy(*keys, "_pair")
        .agg(F.collect_list("_at").alias("_places"))
    )
    found = pairs.join(
        model.select(F.struct("context", "next").alias("_pair"), "loss"), "_pair"
    ).select(*keys, F.explode("_places").alias("_at"), "loss", F.ascii("_pair.next").alias("_code"))
    losses = found.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "loss"))), lambda x: x["loss"]).alias("losses"),
        F.max(F.when(F.col("_at") == 0, F.col("_code"))).alias("first_target"),
    )
    return rows.select(*keys).join(losses, keys, "left").withColumn(
        "losses", F.coalesce("losses", F.array().cast("array<double>"))
    )


def token_losses(chunks: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token_pos, loss): the model's loss for every token of the chunks it was fitted on."""
    scored = chunk_token_losses(chunks, model, keys)
    return scored.select(*keys, F.posexplode("losses").alias("token_pos", "loss"))


def chunk_losses(chunks: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loss, n, first_target): mean token loss of each chunk that predicts any token."""
    scored = chunk_token_losses(chunks, model, keys)
    n = F.size("losses")
    total = F.aggregate("losses", F.lit(0.0), lambda acc, x: acc + x)
    return scored.where(n > 0).select(
        *keys, (total / n).alias("loss"), n.cast("long").alias("n"), "first_target"
    )


def context_entropies(model: DataFrame, vocabulary_size: int) -> DataFrame:
    """(context, entropy): entropy of the smoothed next-character distribution.

    Characters never seen after a context share one probability, so they enter as a product.
    """
    guard = F.lit(vectors.ENTROPY_GUARD)
    whole = F.col("context_n") + F.lit(vocabulary_size)
    seen = (F.col("n") + 1) / whole
    unseen = F.lit(1.0) / whole
    return model.groupBy("context", "context_n").agg(
        F.sum(-seen * F.log(seen + guard)).alias("_seen"), F.count(F.lit(1)).alias("_kinds")
    ).select(
        "context",
        (F.col("_seen") - (F.lit(vocabulary_size) - F.col("_kinds")) * unseen * F.log(unseen + guard)).alias(
            "entropy"
        ),
    )
