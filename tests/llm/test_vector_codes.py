import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from chaffline.llm import queries, vector_codes

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("slot", "codes", "error", "vector", "key", "place", "class")]
)


def rows_of(seed=3, n=120, size=16):
    """Ties, copies, zero vectors, null and odd components, null ids and labels, repeated rows."""
    rng = random.Random(seed)
    vec = lambda: [round(rng.gauss(0, 0.2), 2) for _ in range(size)]
    rows = [(i, vec(), rng.choice([0, 1, 2, None])) for i in range(0, n * 5, 5)]
    rows += [(n * 5 + i, rows[0][1], 1) for i in range(9)] + [(-50, [0.0] * size, 2), (-5, rows[3][1], 0)]
    rows += [(7000, None, 1), (7001, [None] * size, 1), (7002, [math.nan] * size, 1), (7003, [math.inf] + [0.0] * (size - 1), 1)]
    rows += [rows[4], rows[4], (None, vec(), 1), (None, vec(), None), (250, vec(), 1)]
    rng.shuffle(rows)
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, *["in the way"] * (len(SCHEMA) - 3)) for r in rows], SCHEMA).repartition(4)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds by comparing with every entry, in Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if fine(v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        owned = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, owned) if o[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], sha) for (i, _, label), f, err in zip(kept, found, errors)]


@pytest.fixture
def query(spark, tmp_path):
    def run(rows):
        frame_of(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
        return queries.vector_compression(spark, str(tmp_path)).collect()

    return run


@pytest.mark.parametrize("n", [120, 1])
def test_query_equals_lloyd_by_brute_force(query, n):
    rows = rows_of(n=n) if n > 1 else rows_of()[:3]
    assert sorted(map(tuple, query(rows)), key=str) == sorted(brute(rows), key=str)


def test_empty_and_unusable_tables(query, spark):
    assert query([(1, None, 1), (2, [math.nan, 1.0], 1)]) == []
    empty = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[-1] == "codebooks_sha256"


def test_odd_lengths_say_so(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit_codebooks(frame_of(spark, [(1, [1.0] * 9, 1)]))
    with pytest.raises(Exception, match="one length"):
        vector_codes.compress(frame_of(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])).collect()


def test_orchard_gives_the_nearest_and_the_lower_of_ties():
    rng = np.random.default_rng(1)
    for size, spread in ((16, 3), (16, 400), (1, 5), (2, 1)):
        entries, points = rng.integers(-spread, spread + 1, (size, 4)), rng.integers(-spread, spread + 1, (3000, 4))
        best, distance = vector_codes.Neighbours.of(entries).nearest(points)
        every = np.square(points[:, None] - entries[None]).sum(-1)
        assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_orchard_stops_beyond_twice_the_distance(monkeypatch):
    """In clusters far from each other hardly any entry is compared."""
    entries = np.arange(64)[:, None] * 1000 + np.zeros((64, 2), np.int64)
    points = entries[np.zeros(500, int)] + 3
    lists = vector_codes.Neighbours.of(entries)
    compared = []
    square = np.square
    monkeypatch.setattr(vector_codes.np, "square", lambda x: compared.append(len(x)) or square(x))
    lists.nearest(points)
    assert sum(compared) <= 500 * 2


def test_decode_is_within_the_error(spark):
    rows = [r for r in rows_of() if fine(r[1]) and r[0] is not None]
    books = vector_codes.fit_codebooks(frame_of(spark, rows))
    got = vector_codes.encode(frame_of(spark, rows), books).collect()
    given = {}
    for i, v, _ in rows:
        given.setdefault(i, []).append(np.floor(np.float32(v) * 4096))
    for r in got:
        apart = [np.square(books.decode(np.array([r.codes]))[0] * 4096 - v).sum() for v in given[r.vec_id]]
        assert any(abs(a - r.error) < 1e-6 * max(a, 1) for a in apart)
