"""Token ids in Arrow files: batches of fixed-size lists, equal-length sequences with masks.

A file holds one stream of ids cut into rows of `width` ids; the last row is padded and its mask
tells which entries are real. The footer of the Arrow file format lists the record batches, all
of `BATCH_ROWS` rows but the last, so row i of a file is found by division and read without a
copy. A second file beside it says where each document lies. Documents never cross files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.arrays import binaries, bounded, slices
from chaffline.llm.store import attempt_name, locate, new_folder
from chaffline.llm.tokens import TEXT_BYTES, encoder
from chaffline.session import cut_lineage

BATCH_ROWS = 256
#: Ids a file holds before the next one is begun.
FILE_IDS = 32 << 20
#: Bytes of ids that a reader gives out at once.
READ_BYTES = 4 << 20


def file_schema(width: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, width)), ("mask", pa.list_(pa.bool_(), width))])


class TokenWriter:
    """Writes one file of sequences and the file of its documents."""

    def __init__(self, path: str, width: int, kind: pa.DataType):
        self.path, self.width, self.kind = path, width, kind
        self.schema = file_schema(width, kind)
        store, place = locate(path)
        self.sink = store.open_output_stream(place, compression=None)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held, self.ids = 0, 0
        self.doc_ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.counts.append(counts)
        self.waiting.append(ids.astype(self.kind.to_pandas_dtype()))
        self.held += len(ids)
        self.ids += len(ids)
        step = self.width * BATCH_ROWS
        if self.held >= step:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // step * step
            for at in range(0, whole, step):
                self._write(flat[at : at + step], step)
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.width),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.width),
        ]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.width) * self.width, flat.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.file.close()
        self.sink.close()
        counts = np.concatenate(self.counts)
        table = pa.table(
            {"doc_id": pa.concat_arrays(self.doc_ids), "start": np.cumsum(counts) - counts, "n_tokens": counts}
        )
        store, place = locate(documents_path(self.path))
        with store.open_output_stream(place, compression=None) as sink, pa.ipc.new_file(sink, table.schema) as file:
            file.write_table(table)


class TokenFile:
    """Random access to a file of sequences: `sequence(i)`, `stretch(start, n)`, `documents`."""

    def __init__(self, path: str):
        store, place = locate(path)
        local = store.type_name == "local"
        self.source = pa.memory_map(place) if local else store.open_input_file(place)
        self.file = pa.ipc.open_file(self.source)
        self.width = self.file.schema.field("ids").type.list_size
        self._batch: tuple[int, np.ndarray, np.ndarray] | None = None
        store, place = locate(documents_path(path))
        with store.open_input_file(place) as source:
            self.documents = pa.ipc.open_file(source).read_all()

    def _load(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if self._batch is None or self._batch[0] != number:
            batch = self.file.get_batch(number)
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            self._batch = (number, ids, mask)
        return self._batch[1], self._batch[2]

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row, without a copy, and its mask."""
        ids, mask = self._load(row // BATCH_ROWS)
        at = row % BATCH_ROWS * self.width
        return ids[at : at + self.width], mask[at : at + self.width]

    def stretch(self, start: int, size: int) -> np.ndarray:
        """`size` ids of the stream from `start` on."""
        step, parts = self.width * BATCH_ROWS, []
        while size > 0:
            ids, mask = self._load(start // step)
            at = start % step
            part = ids[at : at + size]
            if not mask[at + len(part) - 1]:
                raise ValueError("the stretch goes beyond the end of the stream")
            parts.append(part)
            start, size = start + len(part), size - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def close(self) -> None:
        self._batch = None
        self.source.close()


def documents_path(path: str) -> str:
    return path.removesuffix(".arrow") + ".docs.arrow"


def write_tokens(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    width: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Write the ids of all documents, in ascending order of doc_id, and return the manifest.

    One row per file: part and file (their order is that of the documents), path, n_docs,
    n_tokens, base (ids in the files before). Without `folder` the files go to a new folder below
    the session's checkpoint folder. Files of attempts that failed are in no manifest.

    Null and empty texts are documents of one id, the end. Null doc_ids come first; rows that
    share a doc_id are documents of their own, in the order of their texts. Long texts make long
    files, never cut ones. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = documents.sparkSession
    target = folder or new_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        kind = pa.uint16() if max(encode.size, end_id + 1) <= 1 << 16 else pa.uint32()
        writer, written = None, []
        for batch in slices(batches, text, TEXT_BYTES):
            if writer is None:
                path = f"{target}/{attempt_name(task, len(written), '.arrow')}"
                writer = TokenWriter(path, width, kind)
            writer.add(batch.column(doc_id), *encode.batch(batch, text, end_id))
            if writer.ids >= FILE_IDS:
                writer.close()
                written.append(writer)
                writer = None
        if writer is not None:
            writer.close()
            written.append(writer)
        rows = [(task, i, w.path, sum(map(len, w.counts)), w.ids) for i, w in enumerate(written)]
        names = ["part", "file", "path", "n_docs", "n_tokens"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], MANIFEST)

    ordered = (
        documents.select(doc_id, text).repartitionByRange(F.col(doc_id)).sortWithinPartitions(doc_id, text)
    )
    manifest = cut_lineage(
        ordered.mapInArrow(run, "part long, file long, path string, n_docs long, n_tokens long")
    )
    # One row per file of 32 M ids: a window over all of them stays small.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


MANIFEST = pa.schema(
    [("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
)


def read_tokens(manifest: DataFrame, id_type: T.DataType = T.LongType()) -> DataFrame:
    """The documents of the files of a manifest: doc_id, start, n_tokens, ids.

    `start` counts the ids of all documents before; `ids` are little-endian unsigned 32-bit
    integers. `id_type` is the type of doc_id when the files were written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                yield from _documents(TokenFile(path), base)

    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("start", T.LongType())]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    parallel = manifest.sparkSession.sparkContext.defaultParallelism
    files = manifest.select("path", "base").repartition(max(parallel, 1))
    return files.mapInArrow(run, schema)


def _documents(file: TokenFile, base: int) -> Iterator[pa.RecordBatch]:
    table = file.documents.combine_chunks()
    starts, counts = (np.asarray(table[c]) for c in ("start", "n_tokens"))
    for a, b in bounded((counts * 4).tolist(), READ_BYTES):
        ids = np.concatenate([file.stretch(int(s), int(n)) for s, n in zip(starts[a:b], counts[a:b])])
        data = ids.astype("<u4").view(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                table["doc_id"].slice(a, b - a).combine_chunks(),
                pa.array(base + starts[a:b], pa.int64()),
                pa.array(counts[a:b], pa.int64()),
                binaries(data, np.cumsum(counts[a:b]) * 4),
            ],
            ["doc_id", "start", "n_tokens", "ids"],
        )
    file.close()
