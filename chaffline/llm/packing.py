"""Harmonic packing of token ids into sequences of a fixed capacity.

A piece of length L belongs to class j = capacity // L, and a bin of class j takes j pieces,
whatever they are. Documents are cut so that their pieces come close to capacity / j: a document
gives whole sequences first; what is left is taken as one piece where j such pieces nearly fill a
bin, else a piece of capacity // j for the next larger j is cut off and the rest goes on. Each
partition fills its classes on its own and needs no exchange. Bins that stay open at the end of
a partition are laid end to end, cut into full sequences, and the last stretch into sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chaffline.llm.arrays import binaries, ragged, slices
from chaffline.llm.tokens import TEXT_BYTES, encoder

#: A piece is left whole where its bin's padding is at most this part of the capacity.
SLACK = 64
#: Rests of at most this part of the capacity are never cut further.
TAIL = 32
#: Bits of a sequence id below the partition's number.
SEQUENCE_BITS = 36


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of the given lengths: document, start, length, in document order."""
    whole = lengths // capacity
    documents = [np.repeat(np.arange(len(lengths)), whole)]
    starts = [ragged(np.zeros(len(lengths), np.int64), whole) * capacity]
    sizes = [np.full(int(whole.sum()), capacity)]
    at, left = whole * capacity, lengths % capacity
    open_documents = np.flatnonzero(left)
    while len(open_documents):
        rest = left[open_documents]
        fits = capacity // rest
        size = capacity // -(-capacity // rest)
        size = np.where((rest <= capacity // TAIL) | (capacity - fits * rest <= capacity // SLACK), rest, size)
        documents.append(open_documents)
        starts.append(at[open_documents].copy())
        sizes.append(size)
        at[open_documents] += size
        left[open_documents] -= size
        open_documents = open_documents[left[open_documents] > 0]
    document, start, size = map(np.concatenate, (documents, starts, sizes))
    order = np.lexsort((start, document))
    return document[order], start[order], size[order].astype(np.int64)


class _Bins:
    """The open bins of one partition: pieces with the ids they stand for."""

    def __init__(self, capacity: int, first: int, id_type: pa.DataType):
        self.capacity, self.next = capacity, first
        self.ids = np.zeros(0, np.uint32)
        self.doc_ids = pa.array([], id_type)
        self.table = np.zeros((0, 4), np.int64)  # start, length, tokens of the document, place in ids

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """Take in documents; give back the pieces of all bins that they fill."""
        document, start, size = cut(counts, self.capacity)
        first = np.cumsum(counts) - counts
        new = np.stack((start, size, counts[document], len(self.ids) + first[document] + start), 1)
        table = np.concatenate((self.table, new))
        ids = np.concatenate((self.ids, ids))
        owner = pa.concat_arrays([self.doc_ids, doc_ids.take(pa.array(document))])

        kind = self.capacity // table[:, 1]
        order = np.argsort(kind, kind="stable")
        kinds, began, many = np.unique(kind[order], return_index=True, return_counts=True)
        rank = np.arange(len(order)) - np.repeat(began, many)
        full = rank < np.repeat(many // kinds * kinds, many)
        done, rest = order[full], np.sort(order[~full])
        slot = rank[full] % kind[done]
        sequence = np.cumsum(slot == 0) - 1
        ahead = np.cumsum(table[done, 1]) - table[done, 1]
        offset = ahead - ahead[slot == 0][sequence] if len(done) else ahead
        out = self._rows(owner, table, ids, done, self.next + sequence, offset)
        self.next += int((slot == 0).sum())

        left = table[rest]
        self.ids = ids[ragged(left[:, 3], left[:, 1])]
        self.doc_ids = owner.take(pa.array(rest))
        self.table = np.concatenate((left[:, :3], (np.cumsum(left[:, 1]) - left[:, 1])[:, None]), 1)
        return out

    def close(self) -> pa.RecordBatch:
        """The pieces of the bins still open, laid end to end and cut anew."""
        total = int(self.table[:, 1].sum())
        edges = list(range(0, total - total % self.capacity + 1, self.capacity))
        last = total % self.capacity
        for bit in reversed(range(last.bit_length())):
            if last >> bit & 1:
                edges.append(edges[-1] + (1 << bit))
        edges = np.array(edges)
        ends = np.cumsum(self.table[:, 1])
        cuts = np.union1d(edges[1:], ends)
        begin = np.concatenate(([0], cuts[:-1])) if len(cuts) else cuts
        piece = np.searchsorted(ends, begin, side="right")
        sequence = np.searchsorted(edges, begin, side="right") - 1
        table = np.stack(
            (self.table[piece, 0] + begin - self.table[piece, 3], cuts - begin, self.table[piece, 2], begin), 1
        ).astype(np.int64)
        owner = self.doc_ids.take(pa.array(piece))
        return self._rows(
            owner, table, self.ids, np.arange(len(cuts)), self.next + sequence, begin - edges[sequence]
        )

    def _rows(self, owner, table, ids, chosen, sequence, offset) -> pa.RecordBatch:
        start, size, tokens, place = table[chosen].T
        taken = ids[ragged(place, size)].astype("<u4").view(np.uint8)
        columns = [owner.take(pa.array(chosen)), *(pa.array(x, pa.int64()) for x in (start, size, tokens, sequence, offset))]
        return pa.RecordBatch.from_arrays(
            [*columns, binaries(taken, np.cumsum(size) * 4)],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of tokenised documents, placed in sequences of at most `capacity` ids.

    One row per piece: doc_id, start (the document's ids before it), length, doc_tokens,
    sequence_id, offset (place in the sequence) and ids (little-endian unsigned 32-bit integers).
    `end_id` is added to each document.

    Null and empty texts are documents of one id, the end. Null and repeated doc_ids are kept as
    they are, each row being a document of its own. Long texts give many pieces; memory holds a
    few megabytes of text and the open bins. An empty table gives no rows. Other columns are not
    read. Sequence ids are unique but not dense.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer), None
        for batch in slices(batches, text, TEXT_BYTES):
            if bins is None:
                first = TaskContext.get().partitionId() << SEQUENCE_BITS
                bins = _Bins(capacity, first, batch.column(doc_id).type)
            ids, counts = encode.batch(batch, text, end_id)
            yield bins.add(batch.column(doc_id), ids, counts)
        if bins is not None:
            yield bins.close()

    chosen = documents.select(doc_id, text)
    kind = chosen.schema[doc_id].dataType
    longs = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType(
        [T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in longs], T.StructField("ids", T.BinaryType())]
    )
    return chosen.mapInArrow(run, schema)
