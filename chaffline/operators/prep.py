"""Preparation of texts, token vectors and feature maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffline.functions.grams import Featurizer, hashed_grams
from chaffline.functions.text import pieces
from chaffline.operators.positions import with_running_total

# Bytes of text that a function on texts gets at once, about.
TEXT_BYTES = 4 << 20


def chunk_texts(documents: DataFrame, block_size: int, whole_only: bool = False) -> DataFrame:
    """(doc_id, chunk_idx, chunk): pieces of block_size + 1 characters, the last one shorter.

    Chunks never straddle two documents; an empty document has none. With `whole_only` the
    shorter last pieces are left out. One pass over each text, no shuffle.
    """
    return documents.select(
        "doc_id",
        F.posexplode(pieces(F.col("text"), block_size + 1, whole_only)).alias("chunk_idx", "chunk"),
    )


def chunk_starts(documents: DataFrame, block_size: int, whole_only: bool = False) -> DataFrame:
    """(doc_id, first_sample): how many chunks the documents before have, one row per document."""
    size = F.lit(block_size + 1)
    count = F.call_function("div", F.length("text") + (0 if whole_only else block_size), size)
    counted = documents.select("doc_id", F.coalesce(count, F.lit(0)).alias("_count"))
    return with_running_total(counted, ["doc_id"], "_count", "first_sample").drop("_count")


def numbered_chunks(documents: DataFrame, block_size: int, whole_only: bool = False) -> DataFrame:
    """(sample_id, doc_id, chunk_idx, chunk): chunks with their global position.

    The documents meet one offset each; chunks are cut afterwards and not shuffled.
    """
    started = documents.select("doc_id", "text").join(chunk_starts(documents, block_size, whole_only), "doc_id")
    chunks = started.select(
        "doc_id",
        "first_sample",
        F.posexplode(pieces(F.col("text"), block_size + 1, whole_only)).alias("chunk_idx", "chunk"),
    )
    return chunks.select((F.col("first_sample") + F.col("chunk_idx")).alias("sample_id"), "doc_id", "chunk_idx", "chunk")


def next_token_pairs(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Input and target of next-token prediction; the label is the first target token.

    A chunk of one token has an empty input, an empty target and no label.
    """
    size = F.size(tokens)
    return chunks.select(
        *[c for c in chunks.columns if c != tokens],
        F.slice(tokens, F.lit(1), size - 1).alias("input"),
        F.slice(tokens, F.lit(2), size - 1).alias("target"),
        F.get(tokens, F.lit(1)).cast("long").alias("label"),
    )


def cap_tokens(hidden: DataFrame, limit: int) -> DataFrame:
    """The first `limit` tokens of every sample."""
    return hidden.filter(F.col("token_pos") < limit)


def drop_embedding_layer(hidden: DataFrame) -> DataFrame:
    """All layers but layer 0."""
    return hidden.filter(F.col("layer") >= 1)


def last_layer(hidden: DataFrame) -> DataFrame:
    """Rows of each sample's last layer.

    The last layer comes from a narrow aggregate that is combined before its shuffle, so a
    sample with very many rows is no burden; the rows themselves meet it in a join.
    """
    last = hidden.groupBy("sample_id").agg(F.max("layer").alias("layer"))
    return hidden.join(last, ["sample_id", "layer"], "left_semi")


def feature_map_points(maps: DataFrame) -> DataFrame:
    """(sample_id, position, point): a channels x positions map as one point per position."""
    fmap = F.col("feature_map")
    places = F.sequence(F.lit(0), F.size(F.get(fmap, F.lit(0))) - 1)
    points = F.transform(places, lambda p: F.transform(fmap, lambda channel: F.get(channel, p)))
    return maps.select("sample_id", F.posexplode(points).alias("position", "point"))


def mean_pool(hidden: DataFrame) -> DataFrame:
    """(sample_id, features): the mean of a sample's token vectors, combined before the shuffle."""
    return (
        hidden.select("sample_id", array_to_vector(F.col("vector")).alias("_vector"))
        .groupBy("sample_id")
        .agg(Summarizer.mean(F.col("_vector")).alias("_mean"))
        .select("sample_id", vector_to_array("_mean").alias("features"))
    )


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `TEXT_BYTES` of text, or of one longer text.

    A batch holds up to 10,000 texts or 64 MB, which are several times as much as Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // TEXT_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for first, stop in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(first, stop - first)


def text_features(samples: DataFrame, featurize: Featurizer | None = None) -> DataFrame:
    """(sample_id, features): one vector per text by a function from texts to an (n, d) array.

    The function gets whole texts, of about `TEXT_BYTES` at once, so any model can be put here; the
    default needs none and hashes character grams. No row leaves its partition.
    """
    function = featurize or hashed_grams()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, "text")):
            vectors = function(batch.column("text").to_pylist())
            values = pa.array(np.ascontiguousarray(vectors, dtype=np.float64).ravel())
            offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sample_id"), lists], names=["sample_id", "features"]
            )

    ids = samples.schema["sample_id"].dataType.simpleString()
    return samples.select("sample_id", "text").mapInArrow(
        apply, f"sample_id {ids}, features array<double>"
    )
