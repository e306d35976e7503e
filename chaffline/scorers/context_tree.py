"""A counted character model with longer context: a context tree with escape probabilities.

Each context, from none to `depth` characters, predicts the next character from its own counts and
leaves to the next shorter context the share that new characters had in it (Witten and Bell's
escape). Contexts met less than `least` times are cut off; what they would have said is said by the
shorter one, so all probabilities still sum to 1. Grams are counted in the tasks, as integers, so counts
are shuffled and never characters; probabilities are joined level by level in Spark. The tree is whole
however many rows it has: tasks write it to the shared folder, sorted by hash, and the tasks that score map
those files. A task looks up a window of characters once and keeps its loss.
"""

from __future__ import annotations

import mmap
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffline.session import checkpoint_folder, cut_lineage
from chaffline.sources.runs import _locate

#: Characters of context at most, and times a context must be met.
DEPTH, LEAST = 5, 2
#: Rows that a tree may have, if a caller sets it: a larger tree is then cut by counts. Nothing here sets it.
MODEL_ROWS: int | None = None
#: Rows of a model in a file, about, of 24 bytes each.
FILE_ROWS = 1 << 20
#: Characters that a task works on at once.
CHARACTERS_AT_ONCE = 1 << 18
#: Windows that a task holds, with a count or a loss of 8 bytes, and that it spells at once.
HELD = 1 << 22
ROWS_AT_ONCE = 1 << 16


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > CHARACTERS_AT_ONCE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if len(texts) > first:
        yield first, texts[first:]


class _Letters:
    """Numbers of the characters met so far, from 1 on."""

    def __init__(self, size: int):
        #: Characters that fit a key of `size` numbers, and the bits of a number.
        self.size, self.bits = size, 63 // size
        self.forget()

    def forget(self) -> None:
        self.numbers, self.points = np.zeros(0x110000, np.int64), np.zeros(0, np.uint32)

    def room_for(self, points: np.ndarray) -> bool:
        """Number the characters that are new; False if not all of them had room."""
        new = np.unique(points[self.numbers[points] == 0])
        if len(self.points) + len(new) >= 1 << self.bits:
            return False
        self.meet(new)
        return True

    def meet(self, new: np.ndarray) -> None:
        self.numbers[new] = np.arange(len(self.points) + 1, len(self.points) + len(new) + 1)
        self.points = np.concatenate([self.points, new])


class _Windows:
    """The windows of at most `size` characters of some texts: those that begin at each place, or end there.

    A window is cut short by the end of its text. Each is an exact integer, a letter's number by letter's number,
    from the place on. The keys of several slices of texts agree (`lasting`) while the numbers of `letters` fit;
    else numbers are those of this slice, and where they need more than 63 bits what is there is numbered anew.
    """

    def __init__(self, texts: list[str], points: np.ndarray, letters: _Letters, ending: bool = False):
        self.size, self.lasting = letters.size, letters.room_for(points)
        if not self.lasting:
            letters = _Letters(self.size)
            letters.meet(np.unique(points))
            letters.bits = len(letters.points).bit_length()
        self.points, self.bits = letters.points, letters.bits
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        # Zeros between two texts, as many as a window may reach over the end.
        gap = self.size - 1
        at = np.arange(len(points)) + (self.owner + 1) * gap
        numbers = np.zeros(len(points) + (len(texts) + 1) * gap, np.int64)
        numbers[at] = letters.numbers[points]
        #: By place in a window: the keys that were numbered anew before it, or None.
        self.tables: list[np.ndarray | None] = [None] * self.size
        keys, used = numbers.copy(), self.bits
        for i in range(1, self.size):
            if used + self.bits > 63:
                self.tables[i], keys = np.unique(keys, return_inverse=True)
                used = len(self.tables[i]).bit_length()
            keys <<= self.bits
            if ending:
                keys[i:] |= numbers[:-i]
            else:
                keys[:-i] |= numbers[i:]
            used += self.bits
        self.keys = keys[at]


def _spelt(keys: np.ndarray, found: _Windows | _Letters) -> tuple[np.ndarray, np.ndarray]:
    """Code points of windows (windows, size), the letter of the place first, and how many each has."""
    numbers = np.empty((len(keys), found.size), np.int64)
    tables = getattr(found, "tables", [None] * found.size)
    for i in range(found.size - 1, 0, -1):
        numbers[:, i] = keys & ((1 << found.bits) - 1)
        keys = keys >> found.bits
        if tables[i] is not None:
            keys = tables[i][keys]
    numbers[:, 0] = keys
    return found.points[np.maximum(numbers, 1) - 1], (numbers > 0).sum(axis=1)


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _utf8(points: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The first `lengths` code points of each row in UTF-8, end to end, and where each row begins."""
    there = np.arange(points.shape[1]) < lengths[:, None]
    width = (1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)) * there
    starts = np.concatenate([[0], np.cumsum(width.sum(axis=1))])
    return points[there].astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), starts


def count_grams(chunks: DataFrame, depth: int) -> DataFrame:
    """(gram, n) of all sizes up to depth + 1; grams never straddle two chunks.

    Only the longest gram from each place is counted in the tasks; the shorter ones are its beginnings.
    """

    def rows(keys: np.ndarray, counts: np.ndarray, found: _Windows | _Letters) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), ROWS_AT_ONCE):
            data, starts = _utf8(*_spelt(keys[at : at + ROWS_AT_ONCE], found))
            buffers = pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)
            longest = pa.StringArray.from_buffers(len(starts) - 1, *buffers)
            yield pa.RecordBatch.from_arrays([longest, pa.array(counts[at : at + ROWS_AT_ONCE])], ["longest", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held, size = _Letters(depth + 1), [], 0
        for batch in batches:
            for _, texts in _slices(batch, "chunk"):
                points = _code_points(texts)
                if not letters.room_for(points):
                    for part in held:
                        yield from rows(*part, letters)
                    letters.forget()
                    held, size = [], 0
                found = _Windows(texts, points, letters)
                ordered = np.sort(found.keys)
                first = np.flatnonzero(np.diff(ordered, prepend=-1))
                part = ordered[first], np.diff(first, append=len(ordered)).astype(np.int64)
                if not found.lasting:
                    yield from rows(*part, found)
                    continue
                held.append(part)
                size += len(first)
                if size > HELD:
                    held = [_added_up(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from rows(*held[0], letters)
                        held, size = [], 0
        if held:
            yield from rows(*_added_up(*map(np.concatenate, zip(*held))), letters)

    counted = chunks.select("chunk").mapInArrow(run, "longest string, n long")
    longest = counted.groupBy("longest").agg(F.sum("n").alias("n"))
    beginnings = F.expr("transform(sequence(1, length(longest)), i -> substring(longest, 1, i))")
    return longest.select(F.explode(beginnings).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def _kept(contexts: DataFrame, least: int) -> DataFrame:
    return contexts.where((F.col("total") >= least) | (F.col("context") == ""))


def _least_of(contexts: DataFrame, least: int, most: int) -> int:
    """`least`, doubled until the tree has at most `most` rows."""
    while True:
        rows = _kept(contexts, least).agg(F.coalesce(F.sum("types"), F.lit(0)) + F.count(F.lit(1))).first()[0]
        if rows <= most:
            return least
        least *= 2


def fit_tree(chunks: DataFrame, vocabulary_size: int, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(gram, p, escape): the probability of a gram's last character after the others, and of leaving it as a context.

    Null where a gram is not predicted, or is no context. The row of the empty gram has the share of
    a character that was never seen. The tree is whole, whatever its size, unless `MODEL_ROWS` is set.
    """
    counts = cut_lineage(count_grams(chunks, depth).withColumn("size", F.length("gram")))
    contexts = cut_lineage(
        counts.groupBy(F.expr("substring(gram, 1, size - 1)").alias("context"))
        .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    )
    if MODEL_ROWS is not None:
        least = _least_of(contexts, least, MODEL_ROWS)
    kept = _kept(contexts, least)
    whole = F.col("total") + F.col("types")
    kept = kept.select("context", whole.alias("whole"), "types", (F.col("types") / whole).alias("escape"))
    share = 1.0 / (vocabulary_size + 1)
    lower = counts.sparkSession.createDataFrame([("", share)], "gram string, p double")
    levels = lower
    for size in range(1, depth + 2):
        own = counts.where(F.col("size") == size).select(
            "gram", "n", F.substring("gram", 1, size - 1).alias("context"), F.substring("gram", 2, size - 1).alias("shorter")
        )
        level = own.join(kept.where(F.length("context") == size - 1), "context").join(
            lower.select(F.col("gram").alias("shorter"), F.col("p").alias("below")), "shorter"
        )
        lower = cut_lineage(level.select("gram", ((F.col("n") + F.col("types") * F.col("below")) / F.col("whole")).alias("p")))
        levels = levels.unionByName(lower)
    escapes = kept.select(F.col("context").alias("gram"), "escape")
    return cut_lineage(levels.join(escapes, "gram", "full"))


@dataclass
class Tree:
    """A model in a task: sorted hashes of grams with probabilities (NaN if none) and escapes."""

    hashes: np.ndarray
    chances: np.ndarray
    escapes: np.ndarray
    depth: int
    share: float

    def _values(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and escapes of hashes in order."""
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        known = self.hashes[at] == wanted
        return np.where(known, self.chances[at], np.nan), np.where(known, self.escapes[at], np.nan)

    def _find(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and escapes of grams, given as rows of code points; NaN if there is none."""
        data, starts = _utf8(points, lengths)
        pieces = (data[i:j] for i, j in pairwise(starts.tolist()))
        wanted = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in pieces), np.uint64, len(points)).view(np.int64)
        # In order the search stays in the cache.
        order = np.argsort(wanted)
        chances, escapes = np.empty(len(wanted)), np.empty(len(wanted))
        chances[order], escapes[order] = self._values(wanted[order])
        return chances, escapes

    def window_losses(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The loss of the last character of each window; `points` holds a window from its last to its first.

        The longest gram that is predicted says the probability, times the escapes of the longer contexts.
        """
        chances = np.full(len(points), self.share)
        escapes = np.ones(points.shape)
        open_rows = np.arange(len(points))
        for size in range(points.shape[1], 0, -1):
            rows = open_rows[lengths[open_rows] >= size]
            grams = points[rows, size - 1 :: -1] if size < points.shape[1] else points[rows, ::-1]
            own, _ = self._find(grams, np.full(len(rows), size))
            known = ~np.isnan(own)
            chances[rows[known]] = own[known]
            _, leaving = self._find(grams[~known, : size - 1], np.full((~known).sum(), size - 1))
            escapes[rows[~known], size - 1] = np.where(np.isnan(leaving), 1.0, leaving)
            open_rows = np.setdiff1d(open_rows, rows[known], assume_unique=True)
        for size in range(points.shape[1]):
            chances *= escapes[:, size]
        return -np.log(chances)


@dataclass
class _File:
    """Rows of a model in the shared folder: their hashes in order, then their probabilities, then their escapes."""

    place: str
    rows: int
    first: int

    def mapped(self) -> Tree:
        """The rows without reading them; files of a store that cannot be mapped are fetched to a file without a name."""
        store, path = _locate(self.place)
        if isinstance(store, fs.LocalFileSystem):
            data = pa.memory_map(path).read_buffer()
        else:
            with store.open_input_stream(path) as source, tempfile.TemporaryFile() as copy:
                shutil.copyfileobj(source, copy)
                copy.flush()
                data = mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)
        arrays = (np.frombuffer(data, kind, self.rows, i * 8 * self.rows) for i, kind in enumerate((np.int64, np.float64, np.float64)))
        return Tree(*arrays, 0, np.nan)


class FiledTree(Tree):
    """A model that stays in files of the shared folder, each with a range of hashes. Memory does not grow with it."""

    def __init__(self, files: list[_File], depth: int, share: float):
        self.files, self.depth, self.share = sorted(files, key=lambda f: f.first), depth, share
        self.open: list[Tree | None] = [None] * len(files)

    def _values(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.empty((2, len(wanted)))
        # What comes before the first file is looked for there.
        cuts = np.searchsorted(wanted, np.array([f.first for f in self.files[1:]], np.int64))
        for i, (start, end) in enumerate(pairwise([0, *cuts.tolist(), len(wanted)])):
            if start < end:
                self.open[i] = self.open[i] or self.files[i].mapped()
                found[:, start:end] = self.open[i]._values(wanted[start:end])
        return found[0], found[1]


def file_tree(model: DataFrame, depth: int) -> FiledTree:
    """Write a model's rows to the shared folder, from the tasks; the files stay until their folder is removed.

    The driver gets a line per file. A file of a task that failed is in no line and is never read.
    """
    folder = f"{checkpoint_folder(model.sparkSession).rstrip('/')}/context-tree-{uuid.uuid4().hex[:12]}"
    store, path = _locate(folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not columns:
            return
        hashes, chances, escapes = map(np.concatenate, zip(*columns))
        order = np.argsort(hashes)
        place = f"{folder}/{uuid.uuid4().hex}"
        store, path = _locate(place)
        with store.open_output_stream(path, compression=None) as sink:
            for values in (hashes, chances, escapes):
                sink.write(values[order].tobytes())
        yield pa.RecordBatch.from_pydict({"place": [place], "rows": [len(order)], "first": [hashes[order[0]]]})

    number = lambda c: F.coalesce(c, F.lit(float("nan")))
    # The empty gram is a context only.
    chance = number(F.when(F.col("gram") != "", F.col("p"))).alias("p")
    rows = model.select(F.xxhash64("gram").alias("hash"), chance, number(F.col("escape")).alias("escape"))
    files = rows.repartitionByRange(-(-model.count() // FILE_ROWS), "hash").mapInArrow(write, "place string, rows long, first long")
    share = model.where("gram = ''").select("p").first()[0]
    return FiledTree([_File(*f) for f in files.collect()], depth, share)


class _Scored:
    """The losses of windows that a task has met, `HELD` at most."""

    def __init__(self, tree: Tree):
        self.tree, self.letters = tree, _Letters(tree.depth + 1)
        self.forget()

    def forget(self) -> None:
        self.letters.forget()
        self.keys, self.values, self.new, self.size = np.full(1, -1), np.zeros(1), [], 0

    def _of(self, keys: np.ndarray, found: _Windows) -> np.ndarray:
        if not found.lasting:
            return self.tree.window_losses(*_spelt(keys, found))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        losses = self.values[at]
        missing = np.flatnonzero(self.keys[at] != keys)
        losses[missing] = self.tree.window_losses(*_spelt(keys[missing], found))
        if len(self.keys) < HELD:
            self.new.append((keys[missing], losses[missing]))
            self.size += len(missing)
            if self.size > len(self.keys) // 4:
                self.keys, first = np.unique(np.concatenate([self.keys, *(k for k, _ in self.new)]), return_index=True)
                self.values = np.concatenate([self.values, *(v for _, v in self.new)])[first]
                self.new, self.size = [], 0
        return losses

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The loss of every character but the first of each text, and the text it belongs to."""
        points = _code_points(texts)
        if not self.letters.room_for(points):
            self.forget()
        found = _Windows(texts, points, self.letters, ending=True)
        keys, back = np.unique(found.keys, return_inverse=True)
        later = np.ones(len(back), bool)
        later[found.starts[found.starts < len(back)]] = False
        return self._of(keys, found)[back[later]], found.owner[later]


def tree_losses(chunks: DataFrame, model: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """(keys, loss, n): the mean loss of each chunk that predicts any character, and how many it predicts.

    Any chunks may be scored, also those that the model has not seen. A character never seen has the
    share that all contexts leave to new ones.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(file_tree(model, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scored(shared.value)
        for batch in batches:
            for first, texts in _slices(batch, "chunk"):
                losses, owner = scored.losses(texts)
                n = np.bincount(owner, minlength=len(texts))
                total = np.bincount(owner, weights=losses, minlength=len(texts))
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, len(texts)).take(pa.array(has)) for k in keys), pa.array(total[has] / n[has]), pa.array(n[has].astype(np.int64))],
                    [*keys, "loss", "n"],
                )

    chosen = chunks.select(*keys, "chunk")
    fields = [f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys]
    return chosen.mapInArrow(run, ", ".join([*fields, "loss double", "n long"]))
