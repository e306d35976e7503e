"""Arrow and NumPy helpers shared by the operators that work on batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
LOWER_ASCII = bytes.maketrans(_UPPER, _LOWER)

# Words are runs of digits, ASCII letters in lower case and bytes of non-ASCII characters.
_KEPT = {*range(48, 58), *_LOWER, *range(128, 256)}
WORD_BYTES = bytes(b + 32 if b in _UPPER else b if b in _KEPT else 32 for b in range(256))


def slices(batches, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of about `most_bytes` of text, in order.

    A single row is never cut, however long it is.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column of texts as a plain string array, null as empty."""
    found = batch.column(column)
    return pc.fill_null(found if pa.types.is_string(found.type) else found.cast(pa.string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets from 0 and the bytes of a string array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    view = memoryview(data)[int(offsets[0]) : int(offsets[-1])] if data is not None else memoryview(b"")
    return (offsets - offsets[0]).astype(np.int64), view


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words in lower case: where each text's words begin (one more entry than texts), the words."""
    offsets, data = raw(texts)
    plain = pa.Array.from_buffers(
        pa.string(),
        len(texts),
        [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(bytes(data).translate(WORD_BYTES))],
    )
    lists = pc.ascii_split_whitespace(plain)
    found = lists.flatten()
    real = np.asarray(pc.binary_length(found)) > 0
    before = np.concatenate(([0], np.cumsum(real)))
    starts = np.asarray(lists.offsets, dtype=np.int64)
    return before[starts - starts[0]], found.filter(pa.array(real))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of all stretches, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the stretches of `data` (bytes) that end at `ends`."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def bounded(pieces: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive pieces of at most `most` units in sum, one piece at least."""
    at, total = 0, 0
    for i, size in enumerate(pieces):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(pieces):
        yield at, len(pieces)
