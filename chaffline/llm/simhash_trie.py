"""SimHash near-duplicates: a self-join of one binary trie under a Hamming error budget.

All distinct fingerprints form one binary trie over their bits, from the highest on. Pairs of its
nodes are walked together, one bit a step; the bits in which they differ add up, and a pair beyond the
budget is dropped with all that lies below. The trie is partitioned by its leading bits: a piece is
what lies below a node, and the pairs of nodes that are within the budget there are all that
tasks get; others are dropped before a row moves. Crowded nodes are cut further, by their last bits,
as what lies below one node may agree in many of the next. A piece lives in a task as a sorted
array, a node being a range of it; many pairs are walked at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.llm.arrays import LOWER_ASCII, slices, texts_of
from chaffline.llm.components import components
from chaffline.session import broadcast_if_small, cut_lineage

BITS = 64
SEED = 42
#: Fingerprints below a node of the partition, on average. Larger pieces mean fewer copies of a row: it goes
#: to all nodes within the budget, whose number grows with the bits of the partition.
TRIE_ROWS = 100_000
#: Bits by which the trie is partitioned, and by which a crowded node is cut further, at most.
MOST_PREFIX, MOST_FURTHER = 20, 12
#: Node pairs with at most so many pairs of fingerprints below them are compared directly.
LEAF_PAIRS = 16
#: Pairs that are held at once.
PAIRS_AT_ONCE = 1 << 19

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _rehashed(hashes: np.ndarray, part: int) -> np.ndarray:
    """Hashes for another fingerprint: a one-to-one mix of the first ones, which are part 0."""
    if part == 0:
        return hashes
    mixed = hashes + np.uint64(part * _MIX[0] % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(_MIX[1])
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(_MIX[2])
    return mixed ^ (mixed >> np.uint64(31))


def fingerprint(text: bytes, shingle: int, parts: int = 1) -> list[int]:
    """The SimHashes of a text in UTF-8: a bit is 1 if set in over half of its shingles' hashes."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return [0] * parts
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    count = max(len(words) - shingle + 1, 1)
    begins = (ends - sizes)[:count].tolist()
    lasts = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, lasts)), np.uint64, count)
    found = []
    for part in range(parts):
        columns = _rehashed(hashes, part).view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
        found.append(int.from_bytes(np.packbits(ones * 2 > count, bitorder="little").tobytes(), "little"))
    return found


def fingerprints(
    documents: DataFrame, shingle: int = 4, parts: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprints) of every row, 64 bits each as signed longs. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 8 << 20):
            texts = texts_of(batch, text).cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), shingle, parts) for t in texts], np.uint64).ravel()
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * parts)
            lists = pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), lists], ["doc_id", "fingerprints"])

    chosen = documents.select(doc_id, text)
    kind = chosen.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("fingerprints", T.ArrayType(T.LongType()))]
    )
    return chosen.mapInArrow(run, schema)


def _join_tries(values: np.ndarray, sides: np.ndarray, groups: np.ndarray, budget: int, counts: dict | None = None):
    """Index pairs within the budget, walking all pairs of pieces of the sorted rows at once.

    `groups` numbers the pairs of pieces, ascending, `sides` is 0 or 1 for the two pieces (only pairs
    between them count), and -1 where a piece meets itself; rows are sorted by (group, side, value).
    `counts`, if given, adds up the node pairs that are walked, pruned and compared directly.
    """
    counts = {} if counts is None else counts
    edges = np.flatnonzero(np.concatenate(([True], (np.diff(groups) != 0) | (np.diff(sides) != 0), [True])))
    low, high = edges[:-1], edges[1:]
    whole = sides[low] < 0
    two = np.flatnonzero(sides[low] == 1)
    two = two[(two > 0) & (groups[low[two]] == groups[low[two - 1]])]
    first = np.concatenate((low[whole], low[two - 1]))
    first_end = np.concatenate((high[whole], high[two - 1]))
    second = np.concatenate((low[whole], low[two]))
    second_end = np.concatenate((high[whole], high[two]))
    zero = np.zeros(len(first), np.int64)
    stack = [(first, first_end, second, second_end, zero, 0)]
    while stack:
        a, a_end, b, b_end, errors, bit = stack.pop()
        if len(a) > PAIRS_AT_ONCE // 16:
            half = len(a) // 2
            stack.append((a[half:], a_end[half:], b[half:], b_end[half:], errors[half:], bit))
            a, a_end, b, b_end, errors = a[:half], a_end[:half], b[:half], b_end[:half], errors[:half]
        leaf = ((a_end - a) * (b_end - b) <= LEAF_PAIRS) | (bit == BITS)
        counts["leaves"] = counts.get("leaves", 0) + int(leaf.sum())
        yield from _compare(values, a[leaf], a_end[leaf], b[leaf], b_end[leaf], budget)
        inner = ~leaf
        if not inner.any():
            continue
        a, a_end, b, b_end, errors = a[inner], a_end[inner], b[inner], b_end[inner], errors[inner]
        a_mid, b_mid = _split(values, a, a_end, bit), _split(values, b, b_end, bit)
        same = (a == b) & (a_end == b_end)
        other = ~same
        children = [
            (a, a_mid, b, b_mid, errors),
            (a_mid, a_end, b_mid, b_end, errors),
            (a, a_mid, b_mid, b_end, errors + 1),
            (a_mid[other], a_end[other], b[other], b_mid[other], errors[other] + 1),
        ]
        a, a_end, b, b_end, errors = (np.concatenate(x) for x in zip(*children))
        there = (a < a_end) & (b < b_end)
        keep = there & (errors <= budget)
        counts["walked"] = counts.get("walked", 0) + int(keep.sum())
        counts["pruned"] = counts.get("pruned", 0) + int((there & ~keep).sum())
        stack.append((a[keep], a_end[keep], b[keep], b_end[keep], errors[keep], bit + 1))


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the rows with a 1 at `bit` begin in each range, all of whose rows agree above it."""
    low, high = low.copy(), high.copy()
    mask = np.uint64(1 << (BITS - 1 - bit))
    while True:
        open_ranges = low < high
        if not open_ranges.any():
            return low
        middle = (low + high) // 2
        ones = (values[np.minimum(middle, len(values) - 1)] & mask) != 0
        high = np.where(open_ranges & ones, middle, high)
        low = np.where(open_ranges & ~ones, middle + 1, low)


def _compare(values, a, a_end, b, b_end, budget):
    """Pairs of rows below node pairs, compared in full."""
    many = (a_end - a) * (b_end - b)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), PAIRS_AT_ONCE, side="right")) + at)
        size = many[at:to]
        pair = np.repeat(np.arange(at, to), size)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        width = (b_end - b)[pair]
        left, right = a[pair] + place // width, b[pair] + place % width
        near = np.bitwise_count(values[left] ^ values[right]) <= budget
        near &= left != right
        yield left[near], right[near]
        at = to


class _Forest:
    """Links between positions, kept only where they join two trees."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def add(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        parent, used = self.parent, []
        roots = parent.copy()
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]
        open_links = roots[left] != roots[right]
        for a, b in zip(left[open_links].tolist(), right[open_links].tolist()):
            x, y = a, b
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                used.append((a, b))
        return used


def _links(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            trie = np.asarray(table["trie"])
            last = int(np.searchsorted(trie, trie[-1]))
            if not last:
                held = table
                continue
            yield _of_table(table.slice(0, last), budget)
            held = table.slice(last)
        if held is not None:
            yield _of_table(held, budget)

    return run


def _of_table(table: pa.Table, budget: int) -> pa.RecordBatch:
    values = np.asarray(table["fingerprint"]).view(np.uint64)
    nodes = np.asarray(table["node"])
    sides, groups = np.asarray(table["side"]), np.asarray(table["trie"])
    order = np.lexsort((values, sides, groups))
    values, nodes, sides, groups = values[order], nodes[order], sides[order], groups[order]
    forest, used = _Forest(len(values)), []
    for left, right in _join_tries(values, sides, groups, budget):
        used += forest.add(left, right)
    pairs = np.array(used, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], ["a", "b"])


def prefix_pairs(values: DataFrame, budget: int, rows_per_node: int | None = None) -> DataFrame:
    """Rows (node, fingerprint) as (node, fingerprint, trie, side), once for each pair of trie nodes.

    The nodes are those of the leading bits under which `rows_per_node` rows lie on average. A row
    goes to the pairs of its node with every node that differs from it in at most `budget` of those
    bits. Where one of a pair holds many more rows than that, both are cut further by their last bits,
    and only pairs that are still within the budget are kept.
    """
    per_node = rows_per_node or TRIE_ROWS
    count = values.count()
    bits = min(max(-(-count // per_node) - 1, 0).bit_length(), MOST_PREFIX)
    value = F.col("fingerprint")
    top = lambda width: F.shiftrightunsigned(value, BITS - width) if width else F.lit(0).cast("long")
    rows = values.withColumn("own", top(bits))
    crowded = rows.groupBy("own").count().where(F.col("count") > 2 * per_node)
    further = F.least(F.ceil(F.log2(F.col("count") / per_node)), F.lit(MOST_FURTHER)).cast("int").alias("further")
    crowded = broadcast_if_small(cut_lineage(crowded.select(F.col("own").alias("crowd"), further)))
    masks = [m for n in range(min(budget, bits) + 1) for m in _masks(bits, n)]
    paired = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    paired = paired.withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    for side in ("own", "other"):
        found = crowded.select(F.col("crowd").alias(side), F.col("further").alias(f"{side}_further"))
        paired = paired.join(found, side, "left")
    width = F.greatest(F.coalesce("own_further", F.lit(0)), F.coalesce("other_further", F.lit(0)))
    paired = paired.withColumn("width", width).withColumn("rest", F.lit(budget) - F.bit_count("mask"))
    # The last bits of a row, and what they may be on the other side.
    below = F.expr("fingerprint & (shiftleft(1L, width) - 1)")
    inner = F.expr("filter(sequence(0L, shiftleft(1L, width) - 1), x -> bit_count(x) <= rest)")
    paired = paired.withColumn("below", F.when(F.col("width") > 0, below).otherwise(0))
    paired = paired.withColumn("inner", F.explode(F.when(F.col("width") > 0, inner).otherwise(F.array(F.lit(0).cast("long")))))
    paired = paired.withColumn("other_below", F.col("below").bitwiseXOR(F.col("inner")))
    mine, others = F.struct("own", "below"), F.struct(F.col("other").alias("own"), F.col("other_below").alias("below"))
    return paired.select(
        "node", "fingerprint", F.xxhash64(F.least(mine, others), F.greatest(mine, others)).alias("trie"),
        F.when(mine == others, -1).otherwise((mine > others).cast("int")).alias("side"),
    )


def _masks(bits: int, ones: int) -> list[int]:
    return [sum(1 << i for i in chosen) for chosen in combinations(range(bits), ones)]


def links(nodes: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) that join all (node, fingerprints) rows at most `budget` bits apart.

    Rows are linked if they are that near in any of their fingerprints. Not every pair is listed:
    within a pair of trie nodes those that join nothing new are left out, so the components are the
    same and there are fewer links than rows. Rows must be distinct in their fingerprints.
    """
    numbers = nodes.select(F.max(F.size("fingerprints"))).first()[0] or 0
    found = None
    for number in range(numbers):
        values = nodes.select("node", F.col("fingerprints")[number].alias("fingerprint"))
        own = prefix_pairs(values, budget).withColumn("trie", F.xxhash64("trie", F.lit(number)))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    tries = found.repartition("trie").sortWithinPartitions("trie")
    return tries.mapInArrow(_links(budget), "a long, b long")


def near_duplicates(
    documents: DataFrame,
    shingle: int = 4,
    budget: int = 4,
    parts: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most `budget` bits are linked; component_id is the
    smallest doc_id that links reach. doc_id must be an integer. With `parts` over 1 so many
    independent fingerprints are made of the same shingles, and one that is near is enough: a
    pair of similar documents has so many chances to fall under a small budget, which keeps the
    tries selective where a larger budget would not. The fingerprint given is the first.

    Null texts, empty ones and those of white space have fingerprint zero, which links like any
    other. Documents of equal fingerprints are one node of the join, however many they are;
    repeated rows share it too. A row without a doc_id links nothing: it gets the component of
    equal fingerprints, or null. Long texts are hashed whole. An empty table gives no rows. Other
    columns are not read.
    """
    rows = cut_lineage(fingerprints(documents, shingle, parts, doc_id, text))
    known = rows.where("doc_id IS NOT NULL").groupBy("fingerprints").agg(F.min("doc_id").alias("node"))
    nodes = cut_lineage(known)
    found = components(links(nodes, budget))
    labels = nodes.join(found, "node", "left").select(
        "fingerprints", F.coalesce("component", "node").alias("component_id")
    )
    first = F.get("fingerprints", F.lit(0))
    digits = F.lower(F.lpad(F.hex(first), 16, "0"))
    # Rows of equal fingerprints may be very many: they are narrow, and AQE splits such a join.
    return rows.join(labels, "fingerprints", "left").select(
        "doc_id", digits.alias("fingerprint"), "component_id"
    )
