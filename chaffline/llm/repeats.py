"""Repeated passages by enhanced suffix arrays in buckets, with their common-prefix interval trees.

Every window of `length` bytes has one anchor: the leftmost of its `GRAM`-byte grams with the
smallest hash. Windows that begin next to each other and share their anchor form a stretch. Equal
windows have equal anchors, so it is enough to bring the stretches of an anchor together:

1. Documents are packed into blocks, files of a few megabytes in the shared folder.
2. Each block sends the hashes of its anchors, sorted and once each, to buckets by hash. A bucket
   answers with a bit per anchor: does a second document have it? Most have not.
3. Of the others each block sends its distinct stretches, once each, with the smallest and largest
   document that has them. Stretches of an anchor that is met very often are sent window by
   window, dealt by the window itself, so a frequent line spreads over all buckets.
4. A bucket sorts the suffixes of its stretches, computes common prefixes, and scans them with a
   stack into the tree of common-prefix intervals. An interval of at least `length` bytes whose
   suffixes have different bytes on their left is a maximal repeat there: it answers with
   the interval's length and smallest document to every stretch in it.
5. Blocks put the answers together to the spans of each document.

Only bits, distinct stretches and spans are shuffled, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.arrays import binaries, bounded, ragged, raw, slices, texts_of
from chaffline.llm.store import attempt_name, new_folder, read_bytes, write_bytes
from chaffline.session import cut_lineage

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Positions that are hashed at once.
PART = 1 << 18
#: Bytes of text whose anchors make a bucket on average.
BUCKET_BYTES = 6 << 20
#: Times an anchor may be met before its stretches are sent window by window.
FREQUENT = 4096
#: Suffixes that are sorted at once; the stretches of an anchor stay together.
SUFFIXES = 1 << 16

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Stands for a null doc_id, which comes after all others.
_LAST_ID = (1 << 63) - 1


# Blocks ----------------------------------------------------------------------------------

class Block:
    """Documents one after another: ids, ends and bytes."""

    def __init__(self, data: bytes):
        table = pa.ipc.open_file(pa.py_buffer(data)).read_all().combine_chunks()
        self.ids = np.asarray(table["doc_id"].combine_chunks())
        offsets, view = raw(table["text"].combine_chunks())
        self.edges = offsets
        self.bytes = np.frombuffer(view, np.uint8)


def _write_blocks(documents: DataFrame, folder: str, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = TaskContext.get().partitionId(), []
        held, size = [], 0

        def close() -> None:
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_file(sink, table.schema, options=options) as file:
                file.write_table(table.combine_chunks(), max_chunksize=None)
            path = f"{folder}/{attempt_name(task, len(rows), '.block')}"
            write_bytes(path, sink.getvalue())
            rows.append({"block": (task << 32) + len(rows), "path": path, "bytes": size})

        for batch in slices(batches, text, BLOCK_BYTES):
            texts = texts_of(batch, text)
            own = pa.RecordBatch.from_arrays([batch.column(doc_id), texts], ["doc_id", "text"])
            more = int(raw(texts)[0][-1])
            if held and size + more > BLOCK_BYTES:
                close()
                held, size = [], 0
            held.append(own)
            size += more
        if held:
            close()
        yield pa.RecordBatch.from_pylist(
            rows, pa.schema([("block", pa.int64()), ("path", pa.string()), ("bytes", pa.int64())])
        )

    known = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST_ID)).alias(doc_id)
    chosen = documents.select(known, text)
    return cut_lineage(chosen.mapInArrow(run, "block long, path string, bytes long"))


# Anchors ---------------------------------------------------------------------------------

def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every gram, by doubling; grams beyond the end are left out."""
    width, power, values = 1, _MIX[0], data.astype(np.uint64) + np.uint64(1)
    done: np.ndarray | None = None
    done_width, rest = 0, gram
    while rest:
        if rest & 1:
            if done is None:
                done, done_width = values, width
            else:
                n = len(data) - done_width - width + 1
                done = done[: max(n, 0)] * power + values[done_width : done_width + max(n, 0)]
                done_width += width
        rest >>= 1
        if rest:
            n = max(len(data) - 2 * width + 1, 0)
            values = values[:n] * power + values[width : width + n]
            power = np.uint64(int(power) ** 2 % (1 << 64))
            width *= 2
    return _mixed(done[: max(len(data) - gram + 1, 0)])


def _mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[1]
    values = (values ^ (values >> np.uint64(27))) * _MIX[2]
    return values ^ (values >> np.uint64(31))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows, and document of each stretch of a block."""
    gram = min(24, length)
    room = length - gram + 1
    parts = []
    sizes = np.diff(block.edges)
    for at in range(0, max(len(block.bytes) - length + 1, 0), PART):
        data = block.bytes[at : at + PART + length - 1]
        hashes = _gram_hashes(data, gram)
        low = np.uint64((1 << 20) - 1)
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_smallest(keys, room) & low).astype(np.int64)
        starts = np.arange(at, at + len(anchor))
        owner = np.searchsorted(block.edges, starts, side="right") - 1
        fits = starts + length <= block.edges[owner + 1]
        starts, anchor, owner = starts[fits], anchor[fits], owner[fits]
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(starts) != 1) | (np.diff(owner) != 0)
        first = np.flatnonzero(new)
        # Smallest hashes are small: mixed again, they are spread over all buckets alike.
        parts.append((_mixed(hashes[anchor[first]]), starts[first], np.diff(first, append=len(starts)), owner[first]))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _width(length: int) -> int:
    """Bytes of the longest stretch, in whole 64-bit words."""
    return -(-(2 * length - min(24, length)) // 8) * 8


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _squeeze(data: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(data).tobytes(), codec="zstd", asbytes=True)


def _open(data: bytes, kind, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="zstd"), kind)


# Step 2: which anchors are in two documents -------------------------------------------------

def _anchor_runs(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(read_bytes(row["path"]))
                hashes, _, _, owner = stretches(block, length)
                runs, twice, times = _distinct_anchors(hashes, owner, block.ids)
                bucket = _bucket_of(runs, buckets)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [
                    {
                        "bucket": b, "block": row["block"], "path": row["path"], "n": int(y - x),
                        "hashes": _squeeze(np.diff(runs[x:y], prepend=np.uint64(0))),
                        "twice": np.packbits(twice[x:y]).tobytes(), "times": _squeeze(times[x:y]),
                    }
                    for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x
                ]
                yield pa.RecordBatch.from_pylist(rows, _RUN)

    return run


_RUN = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int64()), ("path", pa.string()), ("n", pa.int64())]
    + [("hashes", pa.binary()), ("twice", pa.binary()), ("times", pa.binary())]
)


def _distinct_anchors(hashes, owner, ids):
    """Sorted distinct hashes, whether two doc_ids of the block have them, and how often they occur."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], ids[owner[order]]
    first = np.flatnonzero(np.concatenate(([True], np.diff(hashes) != 0))) if len(hashes) else np.zeros(0, np.int64)
    if not len(first):
        return hashes, np.zeros(0, bool), np.zeros(0, np.uint32)
    times = np.diff(first, append=len(hashes)).astype(np.uint32)
    return hashes[first], np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first), times


def _answer_anchors(frequent: int):
    """For each run of a bucket: which anchors a second document has, and which are frequent."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        runs = [np.cumsum(_open(r["hashes"], np.uint64, r["n"]), dtype=np.uint64) for r in rows]
        distinct, which, many = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
        times = np.bincount(which, weights=np.concatenate([_open(r["times"], np.uint32, r["n"]) for r in rows]))
        for r, own_run in zip(rows, runs):
            at = np.searchsorted(distinct, own_run)
            own = np.unpackbits(np.frombuffer(r["twice"], np.uint8))[: r["n"]].astype(bool)
            r["shared"] = np.packbits((many[at] > 1) | own).tobytes()
            r["frequent"] = np.packbits(times[at] > frequent).tobytes()
        return pa.Table.from_pylist(rows, _ANSWER)

    return run


_ANSWER = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int64()), ("path", pa.string()), ("n", pa.int64())]
    + [("shared", pa.binary()), ("frequent", pa.binary())]
)


# Step 3: distinct stretches ------------------------------------------------------------------

def _items(block: Block, answers: list[dict], length: int, buckets: int):
    """Shared windows of a block as stretches: bucket, anchor, first window, windows, document.

    The same in every call: step 5 finds its stretches again by this order.
    """
    hashes, first, count, owner = stretches(block, length)
    runs, _, _ = _distinct_anchors(hashes, owner, block.ids)
    shared, frequent = np.zeros(len(runs), bool), np.zeros(len(runs), bool)
    edges = np.searchsorted(_bucket_of(runs, buckets), np.arange(buckets + 1))
    for answer in answers:
        place = slice(edges[answer["bucket"]], edges[answer["bucket"] + 1])
        for name, target in (("shared", shared), ("frequent", frequent)):
            target[place] = np.unpackbits(np.frombuffer(answer[name], np.uint8))[: answer["n"]]
    at = np.searchsorted(runs, hashes)
    keep = shared[at] if len(runs) else np.zeros(0, bool)
    hashes, first, count, owner, at = hashes[keep], first[keep], count[keep], owner[keep], at[keep]
    wide = frequent[at] if len(runs) else keep
    if wide.any():
        # Window by window, dealt by a hash of the window instead of the anchor's.
        windows = ragged(first[wide], count[wide])
        view = np.lib.stride_tricks.sliding_window_view(block.bytes, length)[windows]
        weights = np.cumprod(np.full(length, _MIX[0]), dtype=np.uint64)
        own = (view.astype(np.uint64) + np.uint64(1)) @ weights
        hashes = np.concatenate((hashes[~wide], _mixed(own)))
        owner = np.concatenate((owner[~wide], np.repeat(owner[wide], count[wide])))
        first = np.concatenate((first[~wide], windows))
        count = np.concatenate((count[~wide], np.ones(len(windows), np.int64)))
    return _bucket_of(hashes, buckets), hashes, first, count, owner


def _words(block: Block, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Stretches as rows of big-endian 64-bit words, padded with zeros, their size at the end."""
    padded = np.zeros((len(first), width), np.uint8)
    place = ragged(first, size)
    row = np.repeat(np.arange(len(first)), size)
    padded[row, place - first[row]] = block.bytes[place]
    return padded.view(">u8").astype(np.uint64)


def _distinct_items(block: Block, bucket, hashes, first, count, owner, length: int):
    """Order of the stretches by (bucket, anchor, bytes), and the number of each one's text in it."""
    size = count + length - 1
    words = _words(block, first, size, _width(length))
    order = np.lexsort((*words.T[::-1], size, hashes, bucket))
    new = np.ones(len(order), bool)
    o = order
    new[1:] = (
        (words[o[1:]] != words[o[:-1]]).any(1) | (np.diff(size[o]) != 0) | (np.diff(hashes[o]) != 0)
        | (np.diff(bucket[o]) != 0)
    )
    return order, new


def _send_items(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(read_bytes(row["path"]))
                bucket, hashes, first, count, owner = _items(block, row["answers"], length, buckets)
                if not len(first):
                    continue
                order, new = _distinct_items(block, bucket, hashes, first, count, owner, length)
                heads = np.flatnonzero(new)
                docs = block.ids[owner[order]]
                least, most = np.minimum.reduceat(docs, heads), np.maximum.reduceat(docs, heads)
                one = order[heads]
                edges = np.searchsorted(bucket[one], np.arange(buckets + 1))
                for b, (x, y) in enumerate(zip(edges, edges[1:])):
                    if y > x:
                        own = one[x:y]
                        size = count[own] + length - 1
                        yield pa.RecordBatch.from_pylist(
                            [
                                {
                                    "bucket": b, "block": row["block"], "path": row["path"], "n": int(y - x),
                                    "anchors": _squeeze(hashes[own]), "sizes": _squeeze(size.astype(np.int32)),
                                    "bytes": int(size.sum()),
                                    "data": _squeeze(block.bytes[ragged(first[own], size)]),
                                    "least": _squeeze(least[x:y]), "most": _squeeze(most[x:y]),
                                }
                            ],
                            _ITEM,
                        )

    return run


_ITEM = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int64()), ("path", pa.string()), ("n", pa.int64())]
    + [("anchors", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.int64()), ("data", pa.binary())]
    + [("least", pa.binary()), ("most", pa.binary())]
)


# Step 4: enhanced suffix array of a bucket ------------------------------------------------------

def interval_tree(prefix: np.ndarray, left: np.ndarray, least: np.ndarray, length: int):
    """Maximal repeats of a sorted suffix array: (common prefix, first, last, smallest document).

    `prefix[i]` is what suffix i has in common with suffix i - 1, `left` the byte before a suffix
    (a negative number of its own where there is none), `least` its smallest document. The stack
    holds the open intervals from the shallowest to the deepest one; an interval closes when a
    smaller common prefix comes, and hands its document and left bytes to the one around it.
    An interval is given out if its suffixes do not all have the same byte on their left.
    """
    found = []
    stack: list[list] = []  # common prefix, first, smallest document, left byte or None if several
    n = len(prefix)
    for i in range(1, n + 1):
        depth = int(prefix[i]) if i < n else 0
        at, doc, byte = i - 1, int(least[i - 1]), int(left[i - 1])
        kept = byte
        while stack and stack[-1][0] > depth:
            common, first, own, side = stack.pop()
            doc = min(doc, own)
            side = side if side == kept else None
            if side is None:
                found.append((common, first, i - 1, doc))
            at, kept = first, side
        if depth >= length:
            if stack and stack[-1][0] == depth:
                top = stack[-1]
                top[2] = min(top[2], doc)
                top[3] = top[3] if top[3] == kept else None
            else:
                stack.append([depth, at, doc, kept])
        elif stack:
            raise AssertionError("an interval is left open")
    return found


def _repeats(words, size, group, least, length: int, at_once: int):
    """Answers (row, start, length, smallest document) for distinct stretches sorted by group."""
    edges = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0, [True])))
    many = np.diff(edges)
    rows = np.arange(len(size))
    # A stretch that several documents have is a repeat as a whole, whatever else its anchor has.
    answers = [(rows, np.zeros(len(rows), np.int64), size, least)]
    # Anchors with several stretches, so many at a time that their suffixes stay few.
    several = np.flatnonzero(many > 1)
    suffixes = np.add.reduceat(size - length + 1, edges[:-1])[several]
    for x, y in bounded(suffixes.tolist(), at_once):
        rest = ragged(edges[several[x:y]], many[several[x:y]])
        answers.append(_suffix_repeats(words[rest], size[rest], group[rest], least[rest], length, rest))
    return tuple(np.concatenate(x) for x in zip(*answers))


def _suffix_repeats(words, size, group, least, length: int, names: np.ndarray):
    """The maximal repeats among the suffixes of stretches, as answers for the rows `names`."""
    data = words.astype(">u8").view(np.uint8).reshape(len(words), -1)
    width = data.shape[1]
    count = size - length + 1
    row, start = np.repeat(np.arange(len(size)), count), ragged(np.zeros(len(size), np.int64), count)
    wide = np.concatenate((data, np.zeros_like(data)), 1).ravel()
    suffix = np.lib.stride_tricks.sliding_window_view(wide, width)[row * (2 * width) + start]
    keys = np.ascontiguousarray(suffix).view(">u8").astype(np.uint64)
    left_size = size[row] - start
    order = np.lexsort((left_size, *keys.T[::-1], group[row]))
    row, start, left_size = row[order], start[order], left_size[order]
    text = np.ascontiguousarray(suffix[order])
    differ = text[1:] != text[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.minimum(common, np.minimum(left_size[1:], left_size[:-1]))
    prefix = np.zeros(len(row), np.int64)
    prefix[1:] = np.where(group[row[1:]] == group[row[:-1]], common, 0)
    prefix[prefix < length] = 0
    left = np.where(start > 0, data[row, np.maximum(start - 1, 0)].astype(np.int64), -1 - row)
    # Suffixes that share nothing long enough with a neighbour are their own only occurrence.
    place = np.flatnonzero((prefix > 0) | (np.append(prefix[1:], 0) > 0))
    found = interval_tree(prefix[place], left[place], least[row[place]], length)
    # Intervals come after those inside them. To a suffix that a longer one gave the same document
    # a shorter one says nothing new, so nested intervals of many copies stay few answers.
    told = np.full(len(place), -1, np.int64)
    parts, sizes = [], []
    for _, first, last, doc in found:
        new = np.flatnonzero(told[first : last + 1] != doc) + first
        told[new] = doc
        parts.append(new)
        sizes.append(len(new))
    inside = place[np.concatenate(parts)] if parts else place[:0]
    depth, _, _, doc = np.repeat(np.array(found, np.int64).reshape(-1, 4), sizes, 0).T
    return names[row[inside]], start[inside], depth, doc


def _answer_items(length: int, at_once: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        anchors = np.concatenate([_open(r["anchors"], np.uint64, r["n"]) for r in rows])
        sizes = np.concatenate([_open(r["sizes"], np.int32, r["n"]) for r in rows]).astype(np.int64)
        least = np.concatenate([_open(r["least"], np.int64, r["n"]) for r in rows])
        most = np.concatenate([_open(r["most"], np.int64, r["n"]) for r in rows])
        data = np.concatenate([_open(r["data"], np.uint8, r["bytes"]) for r in rows])
        padded = np.zeros((len(sizes), _width(length)), np.uint8)
        line = np.repeat(np.arange(len(sizes)), sizes)
        padded[line, ragged(np.zeros(len(sizes), np.int64), sizes)] = data
        words = padded.view(">u8").astype(np.uint64)
        order = np.lexsort((*words.T[::-1], sizes, anchors))
        new = np.ones(len(order), bool)
        new[1:] = (
            (words[order[1:]] != words[order[:-1]]).any(1) | (np.diff(sizes[order]) != 0)
            | (np.diff(anchors[order]) != 0)
        )
        heads = np.flatnonzero(new)
        one = order[heads]
        text = np.empty(len(order), np.int64)
        text[order] = np.cumsum(new) - 1
        doc = np.minimum.reduceat(least[order], heads)
        row, start, depth, smallest = _repeats(words[one], sizes[one], anchors[one], doc, length, at_once)

        # Each stretch sent gets the answers of its text that name a smaller document than its largest.
        sort = np.argsort(row, kind="stable")
        row, start, depth, smallest = row[sort], start[sort], depth[sort], smallest[sort]
        edges = np.searchsorted(row, np.arange(len(one) + 1))
        count = (edges[1:] - edges[:-1])[text]
        place = ragged(edges[:-1][text], count)
        item = np.repeat(np.arange(len(sizes)), count)
        useful = smallest[place] < most[item]
        place, item = place[useful], item[useful]
        ends = np.cumsum([r["n"] for r in rows])
        out = []
        for r, end in zip(rows, ends):
            x, y = np.searchsorted(item, (end - r["n"], end))
            if y > x:
                p = place[x:y]
                out.append(
                    {
                        "bucket": r["bucket"], "block": r["block"], "path": r["path"], "n": int(y - x),
                        "items": _squeeze((item[x:y] - (end - r["n"])).astype(np.int32)),
                        "starts": _squeeze(start[p].astype(np.int32)),
                        "lengths": _squeeze(depth[p].astype(np.int32)),
                        "docs": _squeeze(smallest[p].astype(np.int64)),
                    }
                )
        return pa.Table.from_pylist(out, _SPAN)

    return run


_SPAN = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int64()), ("path", pa.string()), ("n", pa.int64())]
    + [("items", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary()), ("docs", pa.binary())]
)


# Step 5: spans of documents ------------------------------------------------------------------

def _covered(block: Block, answers: list[dict], spans: list[dict], length: int, buckets: int) -> np.ndarray:
    """For every byte of a block: is it in a repeat that a smaller document has?"""
    change = np.zeros(len(block.bytes) + 1, np.int32)
    if spans:
        bucket, hashes, first, count, owner = _items(block, answers, length, buckets)
        order, new = _distinct_items(block, bucket, hashes, first, count, owner, length)
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(order))
        edges = np.searchsorted(bucket[order[heads]], np.arange(buckets + 1))
        for r in spans:
            item = _open(r["items"], np.int32, r["n"]).astype(np.int64) + edges[r["bucket"]]
            start, size, doc = (
                _open(r[c], k, r["n"]).astype(np.int64)
                for c, k in (("starts", np.int32), ("lengths", np.int32), ("docs", np.int64))
            )
            many = ends[item] - heads[item]
            own = order[ragged(heads[item], many)]
            which = np.repeat(np.arange(len(item)), many)
            later = block.ids[owner[own]] > doc[which]
            own, which = own[later], which[later]
            begin = first[own] + start[which]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + size[which], -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _finish(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(read_bytes(row["path"]))
                covered = _covered(block, row["answers"] or [], row["spans"] or [], length, buckets)
                sizes = np.diff(block.edges)
                owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                edge = np.zeros(len(covered) + 1, bool)
                edge[block.edges[:-1][sizes > 0]] = True
                before = np.concatenate(([False], covered[:-1])) if len(covered) else covered
                begins = np.flatnonzero(covered & (~before | edge[:-1]))
                after = np.append(covered[1:], False) if len(covered) else covered
                ends = np.flatnonzero(covered & (~after | edge[1:])) + 1
                docs = owner[begins]
                span_edges = np.searchsorted(docs, np.arange(len(sizes) + 1))
                kept = block.bytes[~covered]
                left = np.bincount(owner[~covered], minlength=len(sizes))
                offsets = pa.array(span_edges.astype(np.int32))
                base = block.edges[docs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.ids, mask=block.ids == _LAST_ID),
                        pa.array(sizes.astype(np.int64)),
                        pa.ListArray.from_arrays(
                            offsets,
                            pa.StructArray.from_arrays(
                                [pa.array((begins - base).astype(np.int64)), pa.array((ends - base).astype(np.int64))],
                                ["start", "end"],
                            ),
                        ),
                        binaries(kept, np.cumsum(left)),
                    ],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    return run


def remove_repeats(
    documents: DataFrame,
    length: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
    frequent: int = FREQUENT,
    suffixes: int = SUFFIXES,
) -> DataFrame:
    """Documents without the passages that a document of a smaller doc_id has too.

    A byte goes if it lies in a string of `length` bytes that also starts in a document with a
    smaller doc_id, all judged on the input. One row per document: doc_id, n_bytes, spans (start,
    end of the removed runs) and kept, the bytes that stay. Texts are UTF-8 bytes; matches never
    cross documents, and what stays may cut a character. `frequent` and `suffixes` only say how the
    work is dealt out (see FREQUENT and SUFFIXES).

    doc_id is an integer; rows that repeat one are the same document, so a passage within them is
    no repeat. Null texts are empty. Rows without a doc_id count as one document after all others. Texts shorter
    than `length` stay whole. An empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    manifest = _write_blocks(documents, new_folder(spark, "blocks"), doc_id, text)
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES, 1)

    # One block is a whole task's work: a row of the manifest, dealt out evenly.
    blocks = max(1, manifest.count())
    files = manifest.repartition(blocks)
    runs = files.mapInArrow(
        _anchor_runs(length, buckets), "bucket long, block long, path string, n long, hashes binary, twice binary, times binary"
    )
    answers = runs.groupBy("bucket").applyInArrow(
        _answer_anchors(frequent), "bucket long, block long, path string, n long, shared binary, frequent binary"
    )
    # Per block one answer of each bucket, a few bits for each of its anchors.
    per_block = cut_lineage(
        answers.groupBy("block", "path").agg(
            F.collect_list(F.struct("bucket", "n", "shared", "frequent")).alias("answers")
        )
    )
    items = per_block.repartition(blocks).mapInArrow(
        _send_items(length, buckets),
        "bucket long, block long, path string, n long, anchors binary, sizes binary, bytes long, data binary,"
        " least binary, most binary",
    )
    spans = items.groupBy("bucket").applyInArrow(
        _answer_items(length, suffixes),
        "bucket long, block long, path string, n long, items binary, starts binary, lengths binary, docs binary",
    )
    found = cut_lineage(
        spans.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "items", "starts", "lengths", "docs")).alias("spans"))
    )
    known = per_block.select("block", "answers").join(found, "block", "full")
    return (
        manifest.select("block", "path")
        .join(known, "block", "left")
        .repartition(blocks)
        .mapInArrow(
            _finish(length, buckets),
            T.StructType(
                [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType())]
                + [
                    T.StructField(
                        "spans",
                        T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
                    ),
                    T.StructField("kept", T.BinaryType()),
                ]
            ),
        )
    )
