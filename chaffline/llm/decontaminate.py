"""Benchmark decontamination over a distributed positional inverted index.

Documents are dealt into segments of a few megabytes of text. A segment stores, for each term, the
sorted positions of that term among the segment's words, and a directory of where its documents
end. Test phrases look up their terms' counts over the whole index, rarest first. The rarest term's
postings say which segments can hold a phrase at all; there the offset-adjusted lists are
intersected from the rarest term on. Postings meet phrases by a shuffle on the segment. What is
sent to every task is a bit map of fixed size that says which terms can be test terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.arrays import slices, texts_of, words_of
from chaffline.session import cut_lineage

#: Bytes of text in a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: A segment's number has 63 bits: 31 for its partition, the lowest for its place in the partition.
SEGMENT_BITS = 32
#: Entries of the map of test terms: 128 KiB, whatever the size of the benchmark.
MAP_BITS = 20

_ENTRY = [
    T.StructField("segment", T.LongType()),
    T.StructField("term", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("positions", T.BinaryType()),
]


def _pack(positions: np.ndarray) -> bytes:
    return pa.compress(np.diff(positions, prepend=0).astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, size * 4, codec="zstd"), "<i4").astype(np.int64))


def build_index(documents: DataFrame, terms: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """The positional index: rows (segment, term, n, positions, doc_ids).

    A row without a term is the directory of a segment: its doc_ids and the ends of its documents
    in words. With `terms` (one column `term`) only terms that can be among them are stored.
    """
    spark = documents.sparkSession
    wanted = None
    if terms is not None:
        place = F.xxhash64("term").bitwiseAND(F.lit((1 << MAP_BITS) - 1)).alias("place")
        marks = np.zeros(1 << MAP_BITS, bool)
        marks[np.asarray(terms.select(place).distinct().toArrow()["place"])] = True  # 2**20 rows at most
        wanted = spark.sparkContext.broadcast(np.packbits(marks).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if wanted is None else np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        partition = TaskContext.get().partitionId()
        segment = partition << SEGMENT_BITS
        for batch in slices(batches, text, SEGMENT_BYTES):
            edges, words = words_of(texts_of(batch, text))
            encoded = words.dictionary_encode()
            names, places = encoded.dictionary, np.asarray(encoded.indices)
            order = np.argsort(places, kind="stable")
            counts = np.bincount(places, minlength=len(names))
            ends = np.cumsum(counts)
            chosen = np.arange(len(names))
            if marks is not None:
                mask = (1 << MAP_BITS) - 1
                hashes = (xxhash.xxh64_intdigest(w.as_py(), 42) & mask for w in names.cast(pa.binary()))
                chosen = np.flatnonzero(marks[np.fromiter(hashes, np.int64, len(names))])
            lists = [_pack(order[ends[i] - counts[i] : ends[i]]) for i in chosen]
            size = len(chosen) + 1
            ids = batch.column(doc_id)
            offsets = pa.array(np.concatenate((np.zeros(size), [len(ids)])).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, segment)),
                    pa.concat_arrays([names.take(pa.array(chosen)), pa.nulls(1, pa.string())]),
                    pa.array(np.concatenate((counts[chosen], [len(ids)])).astype(np.int64)),
                    pa.array([*lists, _pack(edges[1:])], pa.binary()),
                    pa.ListArray.from_arrays(offsets, ids),
                ],
                ["segment", "term", "n", "positions", "doc_ids"],
            )
            segment += 1

    chosen = documents.select(doc_id, text)
    kind = chosen.schema[doc_id].dataType
    return chosen.mapInArrow(run, T.StructType([*_ENTRY, T.StructField("doc_ids", T.ArrayType(kind))]))


def phrases_of(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, phrase): the distinct windows of each item, words joined by a space.

    An item of fewer words than a window is one phrase; one without words has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            edges, words = words_of(texts_of(batch, text))
            plain = words.to_pylist()
            rows, found = [], []
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                own = dict.fromkeys(" ".join(plain[s : min(s + window, b)]) for s in range(a, max(b - window, a) + 1) if b > a)
                found += own
                rows += [i] * len(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(item_id).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())],
                ["item_id", "phrase"],
            )

    chosen = items.select(item_id, text)
    kind = chosen.schema[item_id].dataType
    return chosen.mapInArrow(
        run, T.StructType([T.StructField("item_id", kind), T.StructField("phrase", T.StringType())])
    )


def phrase_starts(lists: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Where a phrase begins: positions minus offsets, intersected in the given order."""
    offset, positions = lists[0]
    starts = positions - offset
    for offset, positions in lists[1:]:
        if not len(starts):
            break
        at = np.searchsorted(positions, starts + offset)
        starts = starts[(at < len(positions)) & (positions[np.minimum(at, len(positions) - 1)] == starts + offset)]
    return starts


def near_starts(lists: list[tuple[int, np.ndarray]], within: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortest stretches of at most `within` words that hold every term, in any order.

    Returns first and last positions; no stretch contains another one.
    """
    rare = lists[0][1]
    begins = np.unique(
        np.concatenate([p[_near(p, rare, within)] for _, p in lists])
    )
    ends = np.zeros(len(begins), np.int64)
    for _, positions in lists:
        at = np.searchsorted(positions, begins)
        ends = np.maximum(ends, np.where(at < len(positions), positions[np.minimum(at, len(positions) - 1)], 1 << 60))
    keep = ends - begins < within
    begins, ends = begins[keep], ends[keep]
    tight = np.ones(len(begins), bool)
    tight[:-1] = ends[:-1] != ends[1:]
    return begins[tight], ends[tight]


def _near(positions: np.ndarray, rare: np.ndarray, within: int) -> np.ndarray:
    at = np.searchsorted(rare, positions - within + 1)
    return (at < len(rare)) & (rare[np.minimum(at, len(rare) - 1)] < positions + within)


def search(index: DataFrame, phrases: DataFrame, within: int | None = None) -> DataFrame:
    """Documents with the phrases found in them; `index` must be written (it is read three times).

    Phrases are exact; with `within`, their terms need only lie in some stretch of so many words,
    in any order. One row per document: segment and place (together a key of its own for each row
    of the table), doc_id, n_words, n_hit (words inside a match), and matches: phrase and the
    positions of its first and last words in the document.
    """
    postings = index.where("term IS NOT NULL")
    counts = postings.groupBy("term").agg(F.sum("n").alias("n"))
    words = phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "term"))
    # At most one entry per word of a phrase; phrases with a term that no document has are dropped.
    plans = (
        words.join(counts, "term", "left")
        .groupBy("phrase")
        .agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("plan"), F.count("n").alias("known"))
        .where(F.size("plan") == F.col("known"))
    )
    asked = (
        plans.withColumn("term", F.col("plan")[0]["term"])
        .join(postings.select("term", "segment"), "term")
        .select(
            F.col("segment").alias("home"),
            "phrase",
            F.transform("plan", lambda x: x["at"]).alias("offsets"),
            F.transform("plan", lambda x: x["term"]).alias("terms"),
        )
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search_segment(left, right, within)

    kind = index.schema["doc_ids"].dataType.elementType
    place = T.ArrayType(T.LongType())
    match = T.StructType([T.StructField("phrase", T.StringType()), T.StructField("first", place), T.StructField("last", place)])
    schema = T.StructType(
        [T.StructField("segment", T.LongType()), T.StructField("place", T.LongType())]
        + [T.StructField("doc_id", kind), T.StructField("n_words", T.LongType())]
        + [T.StructField("n_hit", T.LongType()), T.StructField("matches", T.ArrayType(match))]
    )
    return index.groupBy("segment").cogroup(asked.groupBy("home")).applyInArrow(run, schema)


def _search_segment(index: pa.Table, asked: pa.Table, within: int | None) -> pa.Table:
    names = index["term"].to_pylist()
    at = {name: i for i, name in enumerate(names)}
    sizes, data = index["n"].to_pylist(), index["positions"]
    home = at[None]
    ends = _unpack(data[home].as_py(), sizes[home])
    begins = np.concatenate(([0], ends[:-1]))
    doc_ids = pa.concat_arrays(index["doc_ids"].slice(home, 1).chunks).flatten()
    lists: dict[str, np.ndarray] = {}
    found: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
    for phrase, offsets, terms in zip(*(asked[c].to_pylist() for c in ("phrase", "offsets", "terms"))):
        if any(t not in at for t in terms):
            continue
        for term in terms:
            if term not in lists:
                lists[term] = _unpack(data[at[term]].as_py(), sizes[at[term]])
        pairs = [(o, lists[t]) for o, t in zip(offsets, terms)]
        if within is None:
            first = phrase_starts(pairs)
            last = first + len(terms) - 1
        else:
            first, last = near_starts(pairs, within)
        owner = np.searchsorted(ends, first, side="right")
        inside = (first >= 0) & (owner < len(ends))
        inside &= last < ends[np.minimum(owner, len(ends) - 1)]
        if inside.any():
            found.append((phrase, owner[inside], first[inside], last[inside]))

    hit = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    per_document: list[list] = [[] for _ in range(len(ends))]
    for phrase, owner, first, last in found:
        np.add.at(hit, first, 1)
        np.add.at(hit, last + 1, -1)
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:]):
            i = owner[a]
            per_document[i].append(
                {"phrase": phrase, "first": (first[a:b] - begins[i]).tolist(), "last": (last[a:b] - begins[i]).tolist()}
            )
    covered = np.concatenate(([0], np.cumsum(np.cumsum(hit) > 0)))
    segment = index["segment"][0].as_py()
    place = pa.list_(pa.int64())
    return pa.table(
        [
            pa.array(np.full(len(ends), segment)),
            pa.array(np.arange(len(ends))),
            doc_ids,
            pa.array(ends - begins),
            pa.array(covered[ends] - covered[begins]),
            pa.array(per_document, pa.list_(pa.struct([("phrase", pa.string()), ("first", place), ("last", place)]))),
        ],
        names=["segment", "place", "doc_id", "n_words", "n_hit", "matches"],
    )


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Documents with the test items found in them.

    Columns: segment and place (the key of a row), doc_id, n_words, n_hit, items, matches.

    Words are runs of digits, letters a-z (A-Z in lower case) and non-ASCII characters. An item is
    found where any window of its words occurs; n_hit counts the words inside such windows.
    `items` are the found item_ids as sorted strings.

    Null and empty texts have no words; an item without words is never found. Repeated rows are
    documents of their own, repeated items count once. Documents of one long text are segments of
    their own. Empty documents give no rows; an empty benchmark finds nothing. Null item_ids do
    not count as items. Other columns are not read.
    """
    windows = cut_lineage(phrases_of(benchmark, window, item_id, item_text).where("item_id IS NOT NULL").distinct())
    terms = windows.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    index = cut_lineage(build_index(documents, terms, doc_id, text))
    found = cut_lineage(search(index, windows))
    hits = (
        found.select("segment", "place", F.explode("matches.phrase").alias("phrase"))
        .join(windows, "phrase")
        .groupBy("segment", "place")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return found.join(hits, ["segment", "place"], "left").select(
        "segment", "place", "doc_id", "n_words", "n_hit",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "matches",
    )
