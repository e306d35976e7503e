"""Exact nearest neighbours by a blocked self-join.

Vectors are put into blocks of bounded size and a pair of blocks is one task group: a matrix
product per tile, of which only the k best values per vector leave the task. The product is taken
in single precision with a certain bound of its error; only pairs that may be among the best are
measured in double precision. The N * N pairs are never rows, and no block grows with a cluster or
with the copies of one vector.

The blocks of a small table are all paired with each other. Those of a large one are cut along
the data: a vector belongs to the nearest of a set of pivots, and crowded cells are split by a hash. Neighbours
inside the own block give every vector a bound, and it visits another block only if the
triangle inequality leaves room for a distance below that bound. What is skipped cannot hold a
nearer neighbour, so the answer stays exact. In clustered data most visits fall away, for
copies of one vector (bound 0) all of them; data without structure need all N * N products, as
any exact method does. Vectors with few visits are sent to the blocks; those with many would be
copied to all of them. So blocks are written once, in packs, when their bounds are found, and the tasks read
pairs of packs as they are. A vector is shuffled once and written twice, in the precision of its
table: what is shuffled and written grows with the table and not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chaffline.functions.arrays import as_matrix, unit_rows
from chaffline.functions.keys import seeded_key
from chaffline.functions.vectors import SHORTEST_LENGTH, length
from chaffline.session import broadcast_if_small, cut_lineage

# Bytes of double-precision vectors in one block; a task holds two blocks.
BLOCK_BYTES = 64 << 20
# Rows of one block below which more blocks give no useful parallelism.
SMALLEST_BLOCK = 256
# Rows up to which all pairs are taken without asking for bounds, and of a block beyond.
ALL_PAIRS_ROWS = 50_000
BOUNDED_BLOCK = 2048
# Pivots at most; they and their distances to a batch of vectors are held by every task.
MOST_PIVOTS = 4096
# Vectors per side of one matrix product.
TILE = 2048
# The same where packs meet: so few that the products stay in a core's cache.
LOOK = 512
# Slack on the bounds, relative to the distances, for rounding in the products.
SLACK = 1e-7
# Pairs that are measured in double precision at once.
PAIRS_AT_ONCE = 1 << 17
# Vectors whose bounds to all blocks are held at once.
BOUND_ROWS = 256
# Blocks that a vector is sent to at most; one that has to look at more is compared pack by pack.
MOST_VISITS = 8
# Bytes of the vectors of one pack, about, and packs per core at least: a task holds two.
PACK_BYTES = 16 << 20
PACKED_TASKS = 4
# Packs of asking vectors that a task holds; a partition may have a few.
PACKS_HELD = 3
# Share of the vectors that ask from which on the packs ask as they are, and are not written again without the others.
ASKING_SHARE = 0.5

_SCHEMA = "sample_id long, nearest array<double>"


def block_plan(n: int, width: int, cores: int) -> tuple[int, bool]:
    """How many blocks to cut n vectors into, and whether to ask for bounds.

    Their bytes are bounded in any case. A small table gets enough blocks to keep all cores
    busy, a large one so many that visits can be told apart.
    """
    size = n * max(width, 1) * 8
    if n > ALL_PAIRS_ROWS:
        return max(math.ceil(size / PACK_BYTES), min(MOST_PIVOTS, math.ceil(n / BOUNDED_BLOCK))), True
    by_size = math.ceil(size / BLOCK_BYTES)
    by_cores = min(math.ceil(n / SMALLEST_BLOCK), math.ceil(math.sqrt(4 * cores)))
    return max(by_size, by_cores, 1), False


class _Best:
    """The k smallest squared distances seen per row, and the partner of each."""

    def __init__(self, rows: int, k: int) -> None:
        self.cost = np.full((rows, k), np.inf)
        self.partner = np.full((rows, k), -1, dtype=np.int64)

    def merge(self, row: np.ndarray, cost: np.ndarray, partner: np.ndarray) -> None:
        """Take exact squared distances of some pairs into account."""
        if not len(row):
            return
        k = self.cost.shape[1]
        touched, back = np.unique(row, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(touched)), k), back])
        every = np.concatenate([self.cost[touched].ravel(), cost])
        whom = np.concatenate([self.partner[touched].ravel(), partner])
        order = np.lexsort((whom, every, owner))
        owner = owner[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        rank = np.arange(len(owner)) - np.repeat(first, np.diff(first, append=len(owner)))
        kept = order[rank < k]
        self.cost[touched] = every[kept].reshape(-1, k)
        self.partner[touched] = whom[kept].reshape(-1, k)

    def values(self) -> np.ndarray:
        """Distances to the kept partners, ascending; inf where there is none."""
        return np.sqrt(self.cost)


class _Rough:
    """Vectors in single precision, and how wrong a product formula with them may be."""

    def __init__(self, matrix: np.ndarray, centre: np.ndarray) -> None:
        self.exact = matrix
        moved = matrix - centre
        self.single = moved.astype(np.float32)
        squares = (moved**2).sum(1)
        self.squares = squares.astype(np.float32)
        # Worst case of a sum of so many rounded products, and of what is added to it.
        self.slack = (matrix.shape[1] + 16) * 1.2e-7 * squares


def _offer(best: _Best, rows: _Rough, others: _Rough, mine: slice, theirs: slice, rough: np.ndarray) -> int:
    """Show one tile of rough squared distances to the rows' best; returns how many pairs were measured.

    A pair is measured in double precision only if its rough distance leaves room below the row's
    k-th best, so the answer is exact while most pairs cost one single-precision product.
    """
    k, start = best.cost.shape[1], mine.start
    bound = best.cost[mine, -1]
    measured = 0
    seeded = None
    open_rows = np.flatnonzero(np.isinf(bound))
    if len(open_rows):
        some = min(k, rough.shape[1])
        columns = np.argpartition(rough[open_rows], some - 1, axis=1)[:, :some]
        seeded = np.repeat(open_rows, some), columns.ravel()
        real = np.isfinite(rough[seeded])
        measured += _measure(best, rows, others, start, theirs.start, seeded[0][real], seeded[1][real])
        bound = best.cost[mine, -1]
    limit = (bound + rows.slack[mine]).astype(np.float32)[:, None] + others.slack[theirs].astype(np.float32)[None, :]
    wanted = rough <= limit
    wanted[bound == 0] = False  # cannot be improved
    if seeded is not None:
        wanted[seeded] = False
    left, right = np.nonzero(wanted & np.isfinite(rough))
    for at in range(0, len(left), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        measured += _measure(best, rows, others, start, theirs.start, left[part], right[part])
    return measured


def _measure(best, rows, others, start: int, first: int, left: np.ndarray, right: np.ndarray) -> int:
    gaps = rows.exact[start + left] - others.exact[first + right]
    best.merge(start + left, (gaps**2).sum(axis=1), first + right)
    return len(left)


def _rough_tile(rows: _Rough, others: _Rough, mine: slice, theirs: slice) -> np.ndarray:
    products = rows.single[mine] @ others.single[theirs].T
    return rows.squares[mine][:, None] + others.squares[theirs][None, :] - 2 * products


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances by the product formula; exact enough to choose, not to report."""
    return (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2.0 * (left @ right.T)


def _tiles(n: int, step: int = TILE) -> list[slice]:
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def _vectors(column: pa.Array | pa.ChunkedArray, unit: bool) -> np.ndarray:
    """A column of vectors as a double-precision matrix; of their directions with `unit`."""
    return unit_rows(as_matrix(column)) if unit else as_matrix(column)


def _inside(matrix: np.ndarray, k: int) -> _Best:
    """The nearest other rows of the same block."""
    best, rows = _Best(len(matrix), k), _Rough(matrix, matrix.mean(axis=0))
    for i, mine in enumerate(_tiles(len(matrix))):
        for theirs in _tiles(len(matrix))[i:]:
            rough = _rough_tile(rows, rows, mine, theirs)
            if mine == theirs:
                np.fill_diagonal(rough, np.inf)
            _offer(best, rows, rows, mine, theirs, rough)
            if mine != theirs:
                _offer(best, rows, rows, theirs, mine, rough.T)
    return best


def _between(left: np.ndarray, right: np.ndarray, k: int) -> tuple[_Best, _Best]:
    """The nearest rows of the other block, for the rows of each."""
    centre = (left if len(left) else right).mean(axis=0)
    rows, others = _Rough(left, centre), _Rough(right, centre)
    for_left, for_right = _Best(len(left), k), _Best(len(right), k)
    for mine in _tiles(len(left)):
        for theirs in _tiles(len(right)):
            rough = _rough_tile(rows, others, mine, theirs)
            _offer(for_left, rows, others, mine, theirs, rough)
            _offer(for_right, others, rows, theirs, mine, rough.T)
    return for_left, for_right


def _as_lists(values: np.ndarray) -> pa.ListArray:
    kept = np.isfinite(values)
    offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[kept]))


def _compare_blocks(k: int, partners: bool = False, unit: bool = False):
    """Group function over a pair of blocks: each row's best values in the other block.

    With `partners` a value is a pair of distance and partner.
    """

    def lists(best: _Best, others: np.ndarray) -> pa.ListArray:
        values = _as_lists(best.values())
        if not partners:
            return values
        whom = others[best.partner[np.isfinite(best.cost)]]
        pairs = pa.StructArray.from_arrays([values.values, pa.array(whom)], ["distance", "partner"])
        return pa.ListArray.from_arrays(values.offsets, pairs)

    def compare(pair: pa.Table) -> pa.Table:
        ids = pair.column("sample_id").to_numpy()
        matrix = _vectors(pair.column("vector"), unit)
        first = pair.column("block").to_numpy() == pair.column("row_block")[0].as_py()
        if pair.column("row_block")[0] == pair.column("col_block")[0]:
            parts = [(ids, lists(_inside(matrix, k), ids))]
        else:
            left, right = _between(matrix[first], matrix[~first], k)
            parts = [(ids[first], lists(left, ids[~first])), (ids[~first], lists(right, ids[first]))]
        return pa.Table.from_arrays(
            [
                pa.chunked_array([pa.array(i) for i, _ in parts], pa.int64()),
                pa.chunked_array([v for _, v in parts], parts[0][1].type),
            ],
            names=["sample_id", "nearest"],
        )

    return compare


def _tasks(frame: DataFrame, groups: int) -> int:
    """Partitions for groups of heavy work: a few per core, up to 16 groups in one.

    A fixed number, as merging partitions by their bytes would serialise the products.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return max(1, min(groups, max(4 * cores, groups // 16)))


def _per_pair(
    rows: DataFrame, k: int, pairs: int, *keys: str, partners: bool = False, unit: bool = False
) -> DataFrame:
    """(sample_id, nearest) from rows (row_block, col_block, block, sample_id, vector).

    Blocks are told apart by `keys` too, if there are any.
    """
    group = [*keys, "row_block", "col_block"]
    schema = "sample_id long, nearest array<struct<distance: double, partner: long>>" if partners else _SCHEMA
    dealt = rows.repartition(_tasks(rows, pairs), *group)
    return dealt.groupBy(*group).applyInArrow(_compare_blocks(k, partners, unit), schema)


def _all_pairs(vectors: DataFrame, k: int, blocks: int, unit: bool) -> DataFrame:
    own, other = F.col("block"), F.col("_other")
    rows = (
        vectors.withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(
            F.least(own, other).alias("row_block"),
            F.greatest(own, other).alias("col_block"),
            "block",
            "sample_id",
            "vector",
        )
    )
    return _per_pair(rows, k, blocks * (blocks + 1) // 2, unit=unit)


def _assign(vectors: DataFrame, pivots: np.ndarray, kind: str, unit: bool) -> DataFrame:
    """Add `cell`, the nearest pivot, and `radius`, the distance to it."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _vectors(batch.column("vector"), unit)
            cells = [
                _squares(matrix[i : i + TILE], pivots).argmin(axis=1)
                for i in range(0, len(matrix), TILE)
            ]
            cell = np.concatenate(cells)
            radius = np.sqrt(((matrix - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(radius)],
                names=[*batch.schema.names, "cell", "radius"],
            )

    return vectors.mapInArrow(nearest, f"sample_id long, vector array<{kind}>, cell int, radius double")


def _worth_a_look(
    rows: np.ndarray, reach: np.ndarray, home: int, pivots: np.ndarray, shells: np.ndarray
) -> np.ndarray:
    """For rows of one cell and their bounds: which of the blocks may hold a nearer vector (rows, blocks).

    `shells` holds, by block, its pivot and the range of its radii. A vector at distance r from that
    pivot is at least r - high or low - r away from all vectors of the block. As these are nearer to
    their pivot than to the one of this cell, `home`, at distance s, the vector is also at least
    (r * r - s * s) / 2 over the distance of the pivots away.
    """
    cell, low, high = shells[:, 0].astype(int), shells[:, 1], shells[:, 2]
    own = ((rows - pivots[home]) ** 2).sum(axis=1)
    cells, back = np.unique(cell, return_inverse=True)
    twice = 2.0 * np.sqrt(((pivots[cells] - pivots[home]) ** 2).sum(axis=1))
    # Pivots at (almost) the same place divide nothing: no bound from them.
    twice = np.where(twice > SLACK, twice, np.inf)
    wanted = np.zeros((len(rows), len(shells)), bool)
    for start in range(0, len(rows), BOUND_ROWS):
        part = slice(start, start + BOUND_ROWS)
        squares = np.clip(_squares(rows[part], pivots[cells]), 0.0, None)
        beyond = ((squares - own[part, None]) / twice)[:, back]
        away = np.sqrt(squares)
        slack = SLACK * (1.0 + away.max(initial=0.0))
        away = away[:, back]
        gap = np.maximum(np.maximum(away - high, low - away), beyond)
        wanted[part] = gap < reach[part, None] + slack
    return wanted


def _stretches(block: np.ndarray) -> list[slice]:
    """Where each block lies in a pack, whose rows are in the order of blocks."""
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], len(block)])]


_PACK = (
    "pack int, rows int, asking int, block binary, ids binary, vectors binary, reach binary, nearest binary, "
    "visitor binary, target binary"
)


def _bound_packs(k: int, pivots: np.ndarray, shells: np.ndarray, kind: str, unit: bool):
    """Group function over one pack: its blocks, neighbours inside them, and the blocks worth a look per row.

    Gives one row of `_PACK`. A row of the pack that has to look at more than `MOST_VISITS` blocks has its bound in
    `reach` and no targets; the others have no `reach` (NaN).
    """

    def inside(matrix: np.ndarray, own: int) -> tuple[np.ndarray, ...]:
        nearest = _inside(matrix, k).values()
        bound = nearest[:, -1]
        reach = np.full(len(matrix), np.nan)
        visitors, targets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # A bound of 0 cannot be improved.
        open_rows = np.flatnonzero(bound > 0)
        for start in range(0, len(open_rows), BOUND_ROWS):
            rows = open_rows[start : start + BOUND_ROWS]
            wanted = _worth_a_look(matrix[rows], bound[rows], int(shells[own, 0]), pivots, shells)
            wanted[:, own] = False
            wide = wanted.sum(axis=1) > MOST_VISITS
            reach[rows[wide]] = bound[rows[wide]]
            left, right = np.nonzero(wanted & ~wide[:, None])
            visitors.append(rows[left])
            targets.append(right)
        return nearest, reach, np.concatenate(visitors), np.concatenate(targets)

    def bound(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        block = block[order]
        held = as_matrix(table.column("vector"))[order]
        matrix = unit_rows(held) if unit else held
        found = [(part, inside(matrix[part], int(block[part.start]))) for part in _stretches(block)]
        nearest, reach = (np.concatenate([f[i] for _, f in found]) for i in (0, 1))
        visitor = np.concatenate([part.start + f[2] for part, f in found])
        target = np.concatenate([f[3] for _, f in found])
        return _pack_row(
            table, block, order, held.astype(_DTYPES[kind]), reach, nearest, visitor.astype("<i4"), target.astype("<i4")
        )

    return bound


_DTYPES = {"float": "<f4", "double": "<f8"}


def _pack_row(table, block, order, matrix, reach, nearest, visitor, target) -> pa.Table:
    """One row of `_PACK`."""
    ids = table.column("sample_id").to_numpy()[order].astype("<i8")
    held = [block.astype("<i4"), ids, matrix, reach, nearest, visitor, target]
    numbers = [table.column("pack")[0].as_py(), len(block), int((~np.isnan(reach)).sum())]
    columns = [pa.array([i], pa.int32()) for i in numbers] + [pa.array([c.tobytes()], pa.binary()) for c in held]
    return pa.table(dict(zip([field.split()[0] for field in _PACK.split(", ")], columns)))


def _held(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    """A column of a batch of one pack as an array."""
    return np.frombuffer(batch.column(name)[0].as_py(), kind)


def _unpacked(packs: DataFrame, k: int, width: int, kind: str, columns: list[str]) -> DataFrame:
    """The rows of packs: sample_id, block, vector, wide_reach (NULL if it does not ask), nearest, targets, as asked for."""
    types = {
        "sample_id": "long", "block": "int", "vector": f"array<{kind}>", "wide_reach": "double",
        "nearest": "array<double>", "targets": "array<int>",
    }

    def vectors(pack: pa.RecordBatch) -> pa.ListArray:
        values = _held(pack, "vectors", _DTYPES[kind])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, width, dtype=np.int32)), pa.array(values))

    def targets(pack: pa.RecordBatch) -> pa.ListArray:
        sizes = np.bincount(_held(pack, "visitor", "<i4"), minlength=pack.column("rows")[0].as_py())
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_held(pack, "target", "<i4")))

    made = {
        "sample_id": lambda pack: pa.array(_held(pack, "ids", "<i8")),
        "block": lambda pack: pa.array(_held(pack, "block", "<i4")),
        "vector": vectors,
        "wide_reach": lambda pack: pa.array(_held(pack, "reach", "<f8"), from_pandas=True),
        "nearest": lambda pack: _as_lists(_held(pack, "nearest", "<f8").reshape(-1, k)),
        "targets": targets,
    }

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for pack in (many.slice(i, 1) for i in range(many.num_rows)):
                yield pa.RecordBatch.from_arrays([made[c](pack) for c in columns], names=columns)

    return packs.mapInArrow(rows, ", ".join(f"{c} {types[c]}" for c in columns))


def _pack_plan(sizes: dict[int, int], width: int, cores: int) -> list[tuple[int, int]]:
    """(block, pack): neighbouring blocks share a pack of about `PACK_BYTES`, or less to keep all cores busy."""
    by_cores = math.ceil(sum(sizes.values()) / (PACKED_TASKS * cores))
    limit = min(PACK_BYTES // (8 * max(width, 1)), max(by_cores, SMALLEST_BLOCK))
    plan, pack, filled = [], -1, math.inf
    for block in sorted(sizes):
        if filled + sizes[block] > limit:
            pack, filled = pack + 1, 0
        filled += sizes[block]
        plan.append((block, pack))
    return plan


def _by_pack(rows: DataFrame, plan: list[tuple[int, int]], make) -> DataFrame:
    """Rows (block, ...) as one row of `_PACK` per pack, written."""
    # One row per block.
    hinted = F.broadcast(rows.sparkSession.createDataFrame(plan, "block int, pack int"))
    packs = plan[-1][1] + 1
    return cut_lineage(rows.join(hinted, "block").repartitionByRange(packs, "pack").groupBy("pack").applyInArrow(make, _PACK))


def _bounded_pairs(vectors: DataFrame, k: int, blocks: int, unit: bool) -> DataFrame:
    n = vectors.count()
    # Single precision loses nothing of a table that has no more, and is widened inside tasks; so are directions found.
    kind = "float" if vectors.schema["vector"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select("sample_id", F.col("vector").cast(f"array<{kind}>").alias("vector"))
    drawn = rows.orderBy(seeded_key(0, "sample_id"), "sample_id").limit(min(blocks, MOST_PIVOTS))
    pivots = np.array([r.vector for r in drawn.select("vector").collect()], dtype=np.float64)
    pivots = unit_rows(pivots) if unit else pivots
    # Written once: three steps read it, and the pivots' products need not be repeated.
    cells = cut_lineage(_assign(rows, pivots, kind, unit))

    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.ceil(F.col("_n") / math.ceil(n / blocks))
    # One row per pivot.
    plan = sizes.withColumn("_parts", parts).withColumn(
        "_first", F.coalesce(F.sum("_parts").over(before), F.lit(0))
    )
    salt = F.pmod(F.xxhash64("sample_id"), F.col("_parts"))
    placed = cells.join(broadcast_if_small(plan), "cell").withColumn(
        "block", (F.col("_first") + salt).cast("int")
    )
    ranges = placed.groupBy("block").agg(F.first("cell"), F.min("radius"), F.max("radius"), F.count(F.lit(1)))
    found = {r[0]: r[1:] for r in ranges.collect()}
    # Collected: one row per block. A part of a cell may stay empty; nothing is in its reach.
    empty = (0, math.inf, -math.inf, 0)
    shells = np.array([found.get(b, empty)[:3] for b in range(max(found) + 1)], dtype=np.float64)

    width = pivots.shape[1]
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    packs = _by_pack(
        placed.select("block", "sample_id", "vector"),
        _pack_plan({b: f[3] for b, f in found.items()}, width, cores),
        _bound_packs(k, pivots, shells, kind, unit),
    )
    visitors = _unpacked(packs, k, width, kind, ["sample_id", "block", "vector", "targets"])
    found = _unpacked(packs, k, width, kind, ["sample_id", "nearest"])
    visits = partial(_visits, unit=True) if unit else _visits
    found = found.unionByName(visits(visitors, k, math.ceil(n / blocks)))
    looked = _packs_met(packs, k, pivots, shells, kind, unit)
    return found if looked is None else found.unionByName(looked)


def _asking(packs: DataFrame, k: int, width: int, kind: str) -> DataFrame | None:
    """The packs of the vectors that have a reach: `packs` themselves, or new ones if those are few; None without any."""
    n, wide = packs.agg(F.sum("rows"), F.sum("asking")).first()
    if not wide:
        return None
    if wide >= ASKING_SHARE * n:
        return packs
    rows = _unpacked(packs.where("asking > 0"), k, width, kind, ["sample_id", "block", "vector", "wide_reach"])
    rows = rows.where("wide_reach is not null")
    # One row per block.
    sizes = {r[0]: r[1] for r in rows.groupBy("block").count().collect()}

    def pack(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        none = np.zeros(0, "<i4")
        reach = table.column("wide_reach").to_numpy()[order]
        vectors = as_matrix(table.column("vector"))[order].astype(_DTYPES[kind])
        return _pack_row(table, block[order], order, vectors, reach, none, none, none)

    cores = packs.sparkSession.sparkContext.defaultParallelism
    return _by_pack(rows, _pack_plan(sizes, width, cores), pack)


def _packs_met(
    packs: DataFrame, k: int, pivots: np.ndarray, shells: np.ndarray, kind: str, unit: bool
) -> DataFrame | None:
    """(sample_id, nearest): the best values in other blocks of the vectors that ask; None without any.

    A task reads pairs of packs where they are written, so nothing is shuffled for this. It has all pairs of the
    packs that ask in it, so that a vector's values are written once, unless there are too few to keep the cores busy.
    """
    spark = packs.sparkSession
    asking = _asking(packs, k, pivots.shape[1], kind)
    if asking is None:
        return None
    asking = asking.where("asking > 0").select(*[F.col(c).alias(f"l_{c}") for c in ("pack", "block", "ids", "vectors", "reach")])
    every = packs.select(*[F.col(c).alias(f"r_{c}") for c in ("block", "vectors")])
    pairs = asking.crossJoin(every.hint("shuffle_replicate_nl"))
    cores, own = spark.sparkContext.defaultParallelism, asking.rdd.getNumPartitions()
    tasks = own if own > cores else PACKED_TASKS * cores
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    # A row is two packs, and a batch must not hold more of them.
    spark.conf.set(setting, "1")
    try:
        return cut_lineage(pairs.coalesce(tasks).mapInArrow(_meet_packs(k, pivots, shells, kind, unit), _SCHEMA))
    finally:
        spark.conf.set(setting, before)


class _Searching:
    """The vectors of one pack that ask, with their best so far."""

    def __init__(self, blocks: np.ndarray, ids: np.ndarray, matrix: np.ndarray, reach: np.ndarray, k: int, centre: np.ndarray):
        self.ids, self.reach = ids, reach
        self.best, self.rows = _Best(len(ids), k), _Rough(matrix, centre)
        self.parts = [(int(blocks[part.start]), part) for part in _stretches(blocks)]
        d = matrix.shape[1]
        self.exact_squares = ((matrix - centre) ** 2).sum(axis=1)
        self.extended = np.ones((len(ids), d + 2), np.float32)
        self.extended[:, :d] = self.rows.single

    def limits(self, mine) -> np.ndarray:
        return np.minimum(self.reach[mine] ** 2, self.best.cost[mine, -1])

    def look(self, mine: np.ndarray, others: _Rough, extended: np.ndarray, theirs: slice) -> None:
        """Show the rows numbered `mine` a tile of others.

        One single-precision product tells the pairs that may be below a row's limit: with two more
        entries a side it is (limit - squared distance) / 2 and the most that rounding may be wrong by.
        """
        limit = self.limits(mine)
        opened = np.isinf(limit)
        if opened.any():
            # Rows without a limit get one from their nearest of this tile.
            self._seed(mine[opened], others, theirs)
            mine, limit = mine[~opened], limit[~opened]
        d = others.single.shape[1]
        worst = (d + 20) * 1.2e-7
        self.extended[mine, d] = (limit - self.exact_squares[mine]) / 2 + worst * (self.exact_squares[mine] + limit)
        at = np.flatnonzero(self.extended[mine] @ extended[theirs].T >= 0)
        left, right = mine[at // (theirs.stop - theirs.start)], theirs.start + at % (theirs.stop - theirs.start)
        for start in range(0, len(left), PAIRS_AT_ONCE):
            part = slice(start, start + PAIRS_AT_ONCE)
            _measure(self.best, self.rows, others, 0, 0, left[part], right[part])

    def _seed(self, mine: np.ndarray, others: _Rough, theirs: slice) -> None:
        asking = _Rough.__new__(_Rough)
        for name in ("exact", "single", "squares", "slack"):
            setattr(asking, name, getattr(self.rows, name)[mine])
        k = self.best.cost.shape[1]
        best = _Best(len(mine), k)
        best.cost, best.partner = self.best.cost[mine], self.best.partner[mine]
        whole = slice(0, len(mine))
        _offer(best, asking, others, whole, theirs, _rough_tile(asking, others, whole, theirs))
        self.best.cost[mine], self.best.partner[mine] = best.cost, best.partner


def _meet_packs(k: int, pivots: np.ndarray, shells: np.ndarray, kind: str, unit: bool):
    """Arrow function over pairs of packs: the best values of the asking ones in other blocks than their own."""
    centre, width = pivots.mean(axis=0), pivots.shape[1]

    def vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
        matrix = _held(batch, name, _DTYPES[kind]).reshape(-1, width).astype(np.float64)
        return unit_rows(matrix) if unit else matrix

    def search(batch: pa.RecordBatch) -> _Searching:
        reach = _held(batch, "l_reach", "<f8")
        asks = ~np.isnan(reach)
        blocks, ids = _held(batch, "l_block", "<i4")[asks], _held(batch, "l_ids", "<i8")[asks]
        return _Searching(blocks, ids, vectors(batch, "l_vectors")[asks], reach[asks], k, centre)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Searching] = {}

        def results(asking: _Searching) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(asking.ids), _as_lists(asking.best.values())], names=["sample_id", "nearest"]
            )

        for many in batches:
            for batch in (many.slice(i, 1) for i in range(many.num_rows)):
                pack = batch.column("l_pack")[0].as_py()
                if pack not in held:
                    if len(held) == PACKS_HELD:
                        yield results(held.pop(next(iter(held))))
                    held[pack] = search(batch)
                asking = held[pack]
                blocks = _held(batch, "r_block", "<i4")
                others = _Rough(vectors(batch, "r_vectors"), centre)
                squares = ((others.exact - centre) ** 2).sum(axis=1)
                extended = np.ones((len(blocks), width + 2), np.float32)
                extended[:, :width] = others.single
                extended[:, width + 1] = (width + 20) * 1.2e-7 * squares - squares / 2
                stretches = _stretches(blocks)
                whose = [int(blocks[part.start]) for part in stretches]
                for own, mine in asking.parts:
                    rows = np.arange(mine.start, mine.stop)
                    reach = np.sqrt(asking.limits(rows))
                    wanted = _worth_a_look(
                        asking.rows.exact[mine], reach, int(shells[own, 0]), pivots, shells[whose]
                    )
                    for i, part in enumerate(stretches):
                        if whose[i] == own or not wanted[:, i].any():
                            continue
                        first, stop = part.start, part.stop
                        chosen = rows[wanted[:, i]]
                        for asked in _tiles(len(chosen), LOOK):
                            for tile in _tiles(stop - first, LOOK):
                                asking.look(chosen[asked], others, extended, slice(first + tile.start, first + tile.stop))
        for asking in held.values():
            yield results(asking)

    return meet


def _visits(bounded: DataFrame, k: int, limit: int, unit: bool = False) -> DataFrame:
    """(sample_id, nearest): each vector's best values in the blocks it has to look at.

    The visitors of a block are dealt into tables of about `limit`; the block's own vectors are
    sent to each of them. A block that everybody visits is so spread over many groups.
    """
    asked = bounded.select(F.explode("targets").alias("block"))
    # One row per block.
    plan = cut_lineage(
        asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("_tables"))
    )
    hinted = broadcast_if_small(plan)
    tables = plan.agg(F.coalesce(F.sum("_tables"), F.lit(0))).first()[0]
    visitors = (
        bounded.select("sample_id", "vector", F.explode("targets").alias("block"))
        .join(hinted, "block")
        .withColumn("_table", F.pmod(F.xxhash64("sample_id"), F.col("_tables")).cast("int"))
        .select("block", "_table", "sample_id", "vector", F.lit(True).alias("visitor"))
    )
    hosts = (
        bounded.join(hinted, "block")
        .withColumn("_table", F.explode(F.sequence(F.lit(0), F.col("_tables") - 1)))
        .select("block", "_table", "sample_id", "vector", F.lit(False).alias("visitor"))
    )
    return (
        visitors.unionByName(hosts)
        .repartition(_tasks(bounded, tables), "block", "_table")
        .groupBy("block", "_table")
        .applyInArrow(_meet(k, unit), _SCHEMA)
    )


def _meet(k: int, unit: bool):
    """Group function: the visitors' best values among the hosts."""

    def meet(table: pa.Table) -> pa.Table:
        visitor = table.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
        matrix = _vectors(table.column("vector"), unit)
        guests, hosts = matrix[visitor], matrix[~visitor]
        best = _Best(len(guests), k)
        centre = matrix.mean(axis=0)
        rows, others = _Rough(guests, centre), _Rough(hosts, centre)
        for mine in _tiles(len(guests)):
            for theirs in _tiles(len(hosts)):
                _offer(best, rows, others, mine, theirs, _rough_tile(rows, others, mine, theirs))
        return pa.table(
            {
                "sample_id": pa.array(table.column("sample_id").to_numpy()[visitor]),
                "nearest": _as_lists(best.values()),
            }
        )

    return meet


def nearest_within(points: DataFrame, k: int, keys: list[str], rows_per_block: int = BOUNDED_BLOCK) -> DataFrame:
    """(*keys, sample_id, nearest): like `nearest_distances`, within each group of `keys`.

    Groups may be of any size: one of more than `rows_per_block` rows is dealt into blocks, a pair of
    blocks being a task group, so a hot group is spread over all cores and no group is held whole.
    `points` has the columns keys, sample_id (a row's own) and vector, and must be written.
    """
    sizes = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("_blocks"))
    sizes = cut_lineage(sizes)
    pairs = sizes.agg(F.coalesce(F.sum(F.expr("_blocks * (_blocks + 1) div 2")), F.lit(0))).first()[0]
    own, other = F.col("block"), F.col("_other")
    dealt = (
        points.join(broadcast_if_small(sizes), keys)
        .withColumn("block", F.pmod(F.xxhash64("sample_id"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            *keys, F.least(own, other).alias("row_block"), F.greatest(own, other).alias("col_block"), "block",
            "sample_id", "vector",
        )
    )
    found = _per_pair(dealt, k, max(pairs, 1), *keys)
    # A row comes once for each block of its group, with k values at most.
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("nearest"))), 1, k)
    best = found.groupBy("sample_id").agg(merged.alias("distances"))
    return points.select(*keys, "sample_id").join(best, "sample_id")


def nearest_distances(
    vectors: DataFrame,
    k: int,
    column: str = "features",
    blocks: int | None = None,
    bounded: bool | None = None,
    unit: bool = False,
) -> DataFrame:
    """(sample_id, distances): ascending Euclidean distances to the k nearest other samples.

    Fewer than k where there are not that many others. Equal vectors are neighbours at
    distance 0; a sample is told from itself by its row, not by its distance. The blocks and the
    use of bounds follow from the size of the table unless both are given. With `unit` the vectors are
    divided by their lengths first, inside tasks, so that they move in the precision of their table;
    none may be zero.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = vectors.select(
        F.col("sample_id").cast("long").alias("sample_id"), F.col(column).alias("vector")
    )
    if blocks is None or bounded is None:
        n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        cores = rows.sparkSession.sparkContext.defaultParallelism
        planned = block_plan(n, width or 1, cores)
        blocks, bounded = blocks or planned[0], planned[1] if bounded is None else bounded
    found = (_bounded_pairs if bounded else _all_pairs)(rows, k, blocks, unit)
    if k == 1:
        best = F.min(F.get("nearest", F.lit(0)))
        return found.groupBy("sample_id").agg(F.array_compact(F.array(best)).alias("distances"))
    merged = F.array_sort(F.flatten(F.collect_list("nearest")))
    return found.groupBy("sample_id").agg(F.slice(merged, 1, k).alias("distances"))


def approximate_distances(
    vectors: DataFrame,
    k: int,
    bucket_length: float,
    tables: int = 8,
    column: str = "features",
    seed: int = 0,
    rows_per_block: int = 4096,
) -> DataFrame:
    """(sample_id, distances) like `nearest_distances`, but only among candidates.

    Approximate: two samples are compared if a random projection puts them into the same bucket of
    `bucket_length` in one of `tables` tables; a true neighbour in none of them is missed, so
    distances may be too long and lists too short. Ask for it where all pairs are out of reach. A
    bucket of more than `rows_per_block` samples is dealt into pieces whose pairs are tasks of
    their own, so no bucket is cut.
    """
    rows = vectors.select(F.col("sample_id").cast("long").alias("sample_id"), F.col(column).alias("vector"))
    dense = rows.withColumn("_dense", array_to_vector(F.col("vector").cast("array<double>")))
    lsh = BucketedRandomProjectionLSH(
        inputCol="_dense", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    hashed = lsh.fit(dense).transform(dense).select("sample_id", "vector", F.posexplode("_hashes").alias("_table", "_hash"))
    keyed = hashed.select(
        "sample_id", "vector", F.xxhash64("_table", F.get(vector_to_array("_hash"), F.lit(0))).alias("bucket")
    )
    sizes = keyed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("_pieces"))
    sizes = cut_lineage(sizes)
    groups = sizes.agg(F.coalesce(F.sum(F.expr("_pieces * (_pieces + 1) div 2")), F.lit(0))).first()[0]
    large = sizes.where("_pieces > 1")
    own, other = F.col("block"), F.col("_other")
    pieces = F.coalesce("_pieces", F.lit(1))
    dealt = (
        keyed.join(large, "bucket", "left")
        .withColumn("block", F.pmod(F.xxhash64("sample_id"), pieces).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .select(
            "bucket", F.least(own, other).alias("row_block"), F.greatest(own, other).alias("col_block"), "block",
            "sample_id", "vector",
        )
    )
    found = _per_pair(dealt, k, groups, "bucket", partners=True)
    # A neighbour met in several tables comes several times, always with one distance.
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("nearest")))), 1, k)
    return found.groupBy("sample_id").agg(F.transform(merged, lambda pair: pair["distance"]).alias("distances"))


def largest_similarity(
    vectors: DataFrame,
    column: str = "features",
    blocks: int | None = None,
    bounded: bool | None = None,
) -> DataFrame:
    """(sample_id, similarity): the largest cosine to any other sample, NULL for a lone one.

    On unit vectors the cosine is 1 - d * d / 2 of the distance d, so the nearest one has the
    largest. A (near) zero vector has cosine 0 with every other; those are kept out of the
    search and counted instead.
    """
    sized = vectors.select("sample_id", F.col(column).alias("_v"), length(F.col(column)).alias("_size"))
    zero = F.col("_size") < SHORTEST_LENGTH
    others = sized.filter(~zero).select("sample_id", "_v")
    distance = F.get("distances", F.lit(0))
    among = nearest_distances(others, 1, "_v", blocks, bounded, unit=True).select(
        "sample_id", (F.lit(1.0) - distance * distance / 2).alias("similarity")
    )
    zeros = sized.filter(zero).select("sample_id")
    n_zeros, n_all = vectors.select(length(F.col(column)).alias("_size")).agg(
        F.count_if(zero), F.count(F.lit(1))
    ).first()
    if not n_zeros:
        return among
    lone = F.lit(None).cast("double") if n_all == 1 else F.lit(0.0)
    # NULL, where a sample has zero vectors only for company, gives way to their cosine.
    return among.withColumn("similarity", F.greatest("similarity", F.lit(0.0))).unionByName(
        zeros.withColumn("similarity", lone)
    )
