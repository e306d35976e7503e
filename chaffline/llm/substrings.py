"""Repeated word spans by suffix automata of reference shards, against which documents are streamed.

A window of words is removed where its sequence also starts in a document with a smaller id. What
can repeat at all is found first, so that neither references nor streams hold the rest of the text:

1. Every window has an anchor, the leftmost of its word grams with the smallest hash. Anchors of one
   document only (nearly all) rule out their windows; the others are marked in a map of bounded
   size that is sent to all tasks. A mark set by chance costs work, never a result.
2. What is left of a document are stretches of words. Equal stretches are streamed once.
3. The hash of a window tells where it is first met. First windows make the reference, laid out in
   shards of bounded size, each window in one shard; later windows are streamed through the shards
   that hold them.
4. A shard is sent to every task that streams against it, however many a frequent passage needs. The
   task builds the shard's suffix automaton, whose states know the smallest document of their
   strings, and reads each stretch word by word for its matching statistics. Where the match is long
   enough and its state's document is smaller, the window goes.
5. A window that a hash sent to a shard without a match (two windows of one hash) goes round again
   under another hash, so the result does not hang on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.arrays import ragged, raw, slices, texts_of
from chaffline.llm.store import stored
from chaffline.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage

#: Words of an anchor gram.
GRAM = 5
#: Bytes of text that are hashed at once; a longer document is hashed whole.
TEXT_BYTES = 2 << 20
#: Reference windows in a shard, about.
SHARD_WINDOWS = 40_000
#: Windows of a stretch at most: a window's place has so many bits beside the number of its stretch.
PLACE_BITS = 12
#: Stretches of a partition, at most: a number of these bits beside the partition's.
STRETCH_BITS = 24
#: Neighbouring windows of a stretch that go to one shard together.
TOGETHER_BITS = 9
#: Windows that are streamed against a shard in one task, about.
STREAM_WINDOWS = 400_000
#: Spans that are sent to all tasks at most, 16 bytes each; more meet the documents in a shuffle.
BROADCAST_SPANS = 2_000_000
#: Bits of the map of anchors: 16 to 32 for each, and never more than 2**29 (64 MiB).
LEAST_MAP_BITS, MOST_MAP_BITS = 16, 29
#: Bits that an anchor sets in the map.
MARKS = 4
#: Bits of a piece of the map that one task puts together.
PIECE_BITS = 16

# Fixed values of the mixing step of splitmix64, and odd bases of the polynomial hashes.
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BYTE_BASE, _GRAM_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


# Hashes ----------------------------------------------------------------------------------

def _power(base: int, size: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept, as every slice needs them."""
    known = _powers.get(base)
    if known is None or len(known) < size:
        known = np.full(max(size, TEXT_BYTES + 1), base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:size]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


def _stretch_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each values[first:last], whatever its place."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _power(base, len(values)))))
    back = _power(pow(base, -1, 1 << 64), len(values) + 1)
    return _mixed((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


class Words:
    """The words of some texts: where each begins and ends in the bytes, their hashes, and each text's words."""

    def __init__(self, texts: pa.Array):
        edges, view = raw(texts)
        data = np.frombuffer(view, np.uint8) if len(view) else np.zeros(0, np.uint8)
        inside = ~_SPACE[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            starts = edges[:-1][(edges[:-1] < len(data))]
            begins[starts] = inside[starts]
            lasts = edges[1:][edges[1:] > 0] - 1
            ends[lasts] = inside[lasts]
        self.view = view
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.edges = np.searchsorted(self.begin, edges)
        self.hashes = _stretch_hashes(data.astype(np.uint64) + np.uint64(1), self.begin, self.end, _BYTE_BASE)

    def windows(self, size: int) -> np.ndarray:
        """Where the windows of `size` words begin that lie in one text."""
        counts = np.maximum(np.diff(self.edges) - size + 1, 0)
        return ragged(self.edges[:-1], counts)

    def anchors(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window the place of its anchor, and the hashes of the grams at all places."""
        gram = min(GRAM, size)
        n = max(len(self.hashes) - gram + 1, 0)
        at = np.arange(n)
        grams = _stretch_hashes(self.hashes, at, at + gram, _GRAM_BASE)
        place = starts.copy()
        least = grams[starts] if n else np.zeros(0, np.uint64)
        for step in range(1, size - gram + 1):
            other = grams[starts + step]
            less = other < least
            least = np.where(less, other, least)
            place[less] = starts[less] + step
        return place, grams

    def text(self, first: int, last: int) -> str:
        """The words from `first` on, before `last`, joined by one space."""
        whole = bytes(self.view[self.begin[first] : self.end[last - 1]])
        return b" ".join(whole.split()).decode()


# Anchors that more than one document has ---------------------------------------------------

def _anchor_rows(size: int, text: str, doc: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, TEXT_BYTES):
            words = Words(texts_of(batch, text))
            starts = words.windows(size)
            place, grams = words.anchors(starts, size)
            place = np.unique(place)
            ids = np.asarray(batch.column(doc))
            owner = ids[np.searchsorted(words.edges, place, side="right") - 1]
            found = grams[place].view(np.int64)
            order = np.lexsort((owner, found))
            found, owner = found[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, int)
            last = np.append(first[1:], len(found)) - 1 if len(found) else first
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[first]), pa.array(owner[first]), pa.array(owner[last])], ["anchor", "low", "high"]
            )

    return run


def repeated_anchors(documents: DataFrame, size: int, doc: str, text: str) -> DataFrame:
    """(anchor): hashes of the anchor grams that documents of two ids have."""
    rows = documents.select(doc, text).mapInArrow(_anchor_rows(size, text, doc), "anchor long, low long, high long")
    both = rows.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return both.where("low < high").select("anchor")


def _marks(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places in the map that hashes set."""
    values = hashes.view(np.uint64)
    step = _mixed(values) | np.uint64(1)
    return [((values + np.uint64(i) * step) >> np.uint64(64 - bits)).astype(np.int64) for i in range(MARKS)]


def anchor_map(anchors: DataFrame) -> tuple[bytes, int]:
    """A map of bits in which every anchor's places are set, put together in pieces by tasks."""
    count = anchors.count()
    bits = min(max((16 * max(count, 1) - 1).bit_length(), LEAST_MAP_BITS), MOST_MAP_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in _marks(np.asarray(batch.column(0)), bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(place))], ["place"])

    def piece(group: pa.Table) -> pa.Table:
        at = np.asarray(group["place"])
        marks = np.zeros(1 << PIECE_BITS, np.uint8)
        marks[at & ((1 << PIECE_BITS) - 1)] = 1
        return pa.table({"piece": [int(at[0] >> PIECE_BITS)], "marks": [np.packbits(marks).tobytes()]})

    number = F.shiftright("place", PIECE_BITS).alias("piece")
    found = (
        anchors.mapInArrow(places, "place long").distinct()
        .groupBy(number).applyInArrow(piece, "piece long, marks binary")
        .toArrow()  # as large as the map
    )
    whole = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << PIECE_BITS) // 8
    for at, marks in zip(found["piece"].to_pylist(), found["marks"].to_pylist()):
        whole[at * width : (at + 1) * width] = np.frombuffer(marks, np.uint8)
    return whole.tobytes(), bits


def _marked(hashes: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for place in _marks(hashes, bits):
        found &= (marks[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
    return found


# Stretches -------------------------------------------------------------------------------

def stretches(documents: DataFrame, size: int, doc: str, text: str) -> DataFrame:
    """(doc, key, start, n, words): runs of n windows whose anchors several documents may have.

    `key` is a hash of the whole text, `start` the run's first word; at most 2**PLACE_BITS windows a run.
    """
    marks, bits = anchor_map(cut_lineage(repeated_anchors(documents, size, doc, text)))
    sent = documents.sparkSession.sparkContext.broadcast(marks)
    most = 1 << PLACE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)
        for batch in slices(batches, text, TEXT_BYTES):
            words = Words(texts_of(batch, text))
            starts = words.windows(size)
            place, grams = words.anchors(starts, size)
            own, back = np.unique(place, return_inverse=True)
            starts = starts[_marked(grams[own], known, bits)[back]]
            owner = np.searchsorted(words.edges, starts, side="right") - 1
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (np.diff(starts) != 1) | (np.diff(owner) != 0)
            first = np.flatnonzero(fresh)
            # Long runs are cut; the window at a cut begins the next piece.
            lengths = np.diff(np.append(first, len(starts)))
            pieces = -(-lengths // most)
            begin = np.repeat(first, pieces) + ragged(np.zeros(len(first), np.int64), pieces) * most
            end = np.append(begin[1:], len(starts)) - 1
            texts = [words.text(starts[a], starts[b] + size) for a, b in zip(begin.tolist(), end.tolist())]
            rows = pa.array(owner[begin])
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc).take(rows), batch.column("_key").take(rows), pa.array(starts[begin] - words.edges[owner[begin]]), pa.array(end - begin + 1), pa.array(texts, pa.string())],
                ["doc", "key", "start", "n", "words"],
            )

    keyed = documents.select(doc, F.xxhash64(text).alias("_key"), text)
    return keyed.mapInArrow(run, "doc long, key long, start long, n long, words string")


# Windows and where they are first met -----------------------------------------------------

def _window_rows(size: int, turn: int, bits: int):
    """Windows of stretches with hashes of a turn's own; `bits` of a hash are used."""
    base, place_bits = np.uint64(_GRAM_BASE + 4 * turn + 2), PLACE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", TEXT_BYTES):
            words = Words(texts_of(batch, "words"))
            starts = words.windows(size)
            own = _mixed(words.hashes + base)
            found = _stretch_hashes(own, starts, starts + size, int(base) | 1) >> np.uint64(64 - bits)
            owner = np.searchsorted(words.edges, starts, side="right") - 1
            place = (np.asarray(batch.column("sid"))[owner] << place_bits) + starts - words.edges[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), batch.column("doc").take(pa.array(owner)), pa.array(place)],
                ["hash", "doc", "place"],
            )

    return run


# Automata ----------------------------------------------------------------------------------

class SuffixAutomaton:
    """All strings of words in some texts, with the smallest document that holds each."""

    def __init__(self, texts: list[tuple[int, list[str]]]):
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.document = [1 << 63]
        for document, words in texts:
            state = 0
            for word in words:
                state = self._extend(state, word)
                self.document[state] = min(self.document[state], document)
        # A state's strings are suffixes of those it is the link of.
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            if self.document[state] < self.document[above]:
                self.document[above] = self.document[state]

    def _state(self, length: int, link: int, step: dict[str, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.document.append(1 << 63)
        return len(self.link) - 1

    def _split(self, above: int, word: str, state: int) -> int:
        """The state for the strings of `state` that are no longer than those of `above` and a word."""
        if self.length[state] == self.length[above] + 1:
            return state
        copy = self._state(self.length[above] + 1, self.link[state], dict(self.step[state]))
        self.link[state] = copy
        while above >= 0 and self.step[above].get(word) == state:
            self.step[above][word] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, word: str) -> int:
        there = self.step[last].get(word)
        if there is not None:
            return self._split(last, word, there)
        new = self._state(self.length[last] + 1, 0, {})
        above = last
        while above >= 0 and word not in self.step[above]:
            self.step[above][word] = new
            above = self.link[above]
        if above >= 0:
            self.link[new] = self._split(above, word, self.step[above][word])
        return new

    def matches(self, words: list[str], size: int) -> Iterator[tuple[int, int]]:
        """Matching statistics as far as `size`: (end, smallest document) of each window found here."""
        step, link, length = self.step, self.link, self.length
        state = matched = 0
        for end, word in enumerate(words, 1):
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= size:
                # What is longer than a window is not needed; shorter strings may have smaller documents.
                while length[link[state]] >= size:
                    state = link[state]
                matched = min(matched, length[state])
                yield end, self.document[state]


def _stream(size: int):
    """Stretches of a piece against their shard: the spans that go, and the windows sent in vain."""

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton([(d, t.split(" ")) for d, t in zip(shard["doc"].to_pylist(), shard["words"].to_pylist())])
        out: list[tuple[int, int, int, bool]] = []
        for sid, doc, start, count, text in zip(*(asked[c].to_pylist() for c in ("sid", "doc", "start", "n", "words"))):
            hit = np.full(count, -1, np.int8)
            for end, smallest in automaton.matches(text.split(" "), size):
                hit[end - size] = smallest < doc
            edges = np.flatnonzero(np.diff(hit, prepend=2, append=2))
            out += [(sid, start + int(a), start + int(b), hit[a] > 0) for a, b in zip(edges, edges[1:]) if hit[a]]
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sid", "first", "last", "found"])

    return run


def _cut_runs(size: int, columns: list[str]):
    """Rows with a stretch's words and window starts (ascending) as one row for each run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, places = batch.column("words").to_pylist(), batch.column("places").to_pylist()
            rows, starts, counts, texts = [], [], [], []
            for i, (text, own) in enumerate(zip(words, places)):
                split = text.split(" ")
                own = np.unique(own)
                edges = np.flatnonzero(np.diff(own, prepend=own[0] - 2, append=own[-1] + 2) != 1)
                for a, b in zip(edges, edges[1:]):
                    rows.append(i)
                    starts.append(int(own[a]))
                    counts.append(int(b - a))
                    texts.append(" ".join(split[own[a] : own[b - 1] + size]))
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())],
                [*columns, "start", "n", "words"],
            )

    return run


def _round(runs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Spans (sid, first, last, found) of the windows that were sent to a shard; in windows of a stretch."""
    first = windows.groupBy("hash").agg(
        F.min_by("place", "doc").alias("first"), F.min("doc").alias("low"), F.max("doc").alias("high")
    )
    first = stored(first.where("low < high").select("hash", "first", "low"), "windows")
    shards = max(1, -(-first.count() // SHARD_WINDOWS))
    # Neighbouring first windows share a shard, so that runs of them stay whole.
    shard = F.pmod(F.xxhash64(F.shiftright("first", TOGETHER_BITS)), F.lit(shards)).alias("shard")
    texts = runs.select("sid", "doc", "words")
    sid, at = F.shiftright("place", PLACE_BITS).alias("sid"), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
    places = F.collect_list(at.cast("int")).alias("places")
    cut = "shard long, {}doc long, start long, n long, words string"
    reference = first.select(shard, F.col("first").alias("place")).groupBy("shard", sid).agg(places)
    reference = reference.join(texts, "sid").mapInArrow(_cut_runs(size, ["shard", "doc"]), cut.format(""))
    asked = windows.join(first, "hash").where("doc > low").select(shard, "place").groupBy("shard", sid).agg(places)
    asked = asked.join(texts, "sid").mapInArrow(_cut_runs(size, ["shard", "sid", "doc"]), cut.format("sid long, "))
    asked = stored(asked, "streams")
    pieces = asked.groupBy("shard").agg(F.ceil(F.sum("n") / STREAM_WINDOWS).cast("int").alias("pieces"))
    pieces = broadcast_if_small(cut_lineage(pieces))
    dealt = asked.join(pieces, "shard").withColumn("piece", F.pmod(F.xxhash64("sid", "start"), F.col("pieces")).cast("int"))
    sent = reference.join(pieces, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return cut_lineage(
        sent.select("shard", "piece", "doc", "words").groupBy("shard", "piece")
        .cogroup(dealt.select("shard", "piece", "sid", "doc", "start", "n", "words").groupBy("shard", "piece"))
        .applyInArrow(_stream(size), "sid long, first long, last long, found boolean")
    )


def repeated_spans(documents: DataFrame, size: int, doc: str, text: str, bits: int = 64) -> DataFrame:
    """(doc, key, first, last): spans of words, one at least in each document that has any.

    A word of a span lies in a window that also starts in a document of a smaller id. `key` is a
    hash of the text; rows without an id are left out. `bits` of a window's hash decide where it is
    sent; fewer cost more rounds and change nothing else.
    """
    known = documents.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    number = F.monotonically_increasing_id()
    row, part = number.bitwiseAND((1 << 33) - 1), F.shiftright(number, 33)
    sid = F.when(row < 1 << STRETCH_BITS, F.shiftleft(part, STRETCH_BITS) + row).otherwise(
        F.raise_error(F.lit("a partition has too many stretches")).cast("long")
    )
    every = stretches(known, size, "doc", "text").withColumn("digest", F.unhex(F.sha2("words", 256)))
    every = stored(every.withColumn("sid", sid), "stretches")
    # Of equal stretches the one of the smallest document is streamed; in later documents all of it goes.
    chief = every.groupBy("digest").agg(F.min(F.struct("doc", "sid")).alias("chief"))
    chief = cut_lineage(chief.select("digest", F.col("chief.doc").alias("chief_doc"), F.col("chief.sid").alias("chief_sid")))
    runs = stored(every.join(chief.select(F.col("chief_sid").alias("sid")), "sid", "left_semi").select("sid", "doc", "words"), "runs")

    spans, pending, turn = [], runs, 0
    while True:
        rows = _window_rows(size, turn, min(bits + 8 * turn, 64))
        windows = pending.mapInArrow(rows, "hash long, doc long, place long")
        if turn:
            windows = windows.join(places, "place", "left_semi")
        found = _round(runs, windows, size)
        spans.append(found.where("found").select("sid", "first", "last"))
        vain = found.where("NOT found")
        if vain.isEmpty():
            break
        # All windows of a hash that sent one in vain go again, as the first of them may share it.
        begin = F.shiftleft("sid", PLACE_BITS)
        vain = vain.select(F.explode(F.sequence(begin + F.col("first"), begin + F.col("last") - 1)).alias("place"))
        hashes = windows.join(vain, "place", "left_semi").select("hash").distinct()
        places = cut_lineage(windows.join(hashes, "hash", "left_semi").select("place"))
        pending = runs.join(places.select(F.shiftright("place", PLACE_BITS).alias("sid")).distinct(), "sid", "left_semi")
        turn += 1
    found = reduce(DataFrame.union, spans).groupBy("sid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    own = every.drop("words").join(chief, "digest")
    whole = own.where("doc > chief_doc").select("doc", "key", F.col("start").alias("first"), (F.col("start") + F.col("n") + size - 1).alias("last"))
    parts = own.where("doc = chief_doc").join(found.withColumnRenamed("sid", "chief_sid"), "chief_sid")
    parts = parts.select("doc", "key", "start", F.explode("spans").alias("span")).select(
        "doc", "key", (F.col("start") + F.col("span.first")).alias("first"), (F.col("start") + F.col("span.last") + size - 1).alias("last")
    )
    return whole.union(parts)


# Documents ---------------------------------------------------------------------------------

def _remove(doc_id: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, TEXT_BYTES):
            words, kept, removed = [], [], []
            texts, spans = texts_of(batch, text), batch.column("spans").to_pylist()
            for value, own in zip(texts.cast(pa.binary()), spans):
                split = value.as_py().split()
                gone = np.zeros(len(split) + 1, np.int64)
                for span in own or []:
                    gone[span["first"]] += 1
                    gone[span["last"]] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                words.append(len(split))
                edges = np.flatnonzero(np.diff(covered, prepend=False, append=False))
                removed.append([{"first": int(a), "last": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                if len(edges):
                    split = [w for w, c in zip(split, covered.tolist()) if not c]
                kept.append(b" ".join(split))
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id), pa.array(words, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "spans", "kept"],
            )

    return run


def remove_repeated_spans(documents: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the word spans that a document of a smaller doc_id has too.

    Words are what white space (the six ASCII characters) parts, unchanged. A word goes if it lies in
    a window of `size` words whose sequence also starts in a document with a smaller doc_id, all judged
    on the input. One row per row: doc_id, n_words, spans (first, last of the removed runs, the last
    one excluded), and kept, the UTF-8 bytes of the words that stay, joined by one space.

    doc_id is an integer. Rows that repeat one are the same document: they take nothing from each
    other, whether their texts are equal or not. Rows without a doc_id have none smaller and are
    smaller than none, so they stay whole and take nothing. Null texts have no words; texts of fewer
    than `size` words stay whole. Texts are read whole, however long. An empty table gives no rows.
    Other columns are not read. `documents` is read three times.
    """
    spans = cut_lineage(
        repeated_spans(documents, size, doc_id, text).groupBy("doc", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )
    rows, total = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and total <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    plain = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = plain.withColumn("key", F.xxhash64("text")).withColumn("doc", F.col("doc_id").cast("long"))
    joined = keyed.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans")
    schema = T.StructType(
        [T.StructField("doc_id", plain.schema["doc_id"].dataType), T.StructField("n_words", T.LongType())]
        + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])))]
        + [T.StructField("kept", T.BinaryType())]
    )
    return joined.mapInArrow(_remove("doc_id", "text"), schema)
