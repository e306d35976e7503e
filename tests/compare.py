"""Compare a Spark result with a DuckDB result: names, rows and values, order aside."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    """A value that sorts and compares alike whichever engine it came from."""
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, int(value))
    if isinstance(value, float):
        return (2, "nan") if math.isnan(value) else (1, value + 0.0)
    if isinstance(value, int):
        return (1, value)
    if isinstance(value, (list, tuple)):
        return (4, tuple(plain(v) for v in value))
    return (3, str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {
    "bigint": "int64", "long": "int64", "int": "int32", "integer": "int32", "double": "double",
    "string": "string", "varchar": "string", "boolean": "bool", "float": "float",
}


def differences(result, connection, sql):
    """Lines that tell where the two results differ; empty when they agree."""
    expected = connection.execute(sql)
    description = expected.description
    names, rows = rows_of([d[0] for d in description], expected.fetchall())
    found_names, found = rows_of(result.columns, [tuple(r) for r in result.collect()])
    problems = []
    if names != found_names:
        return [f"columns {found_names} against {names}"]
    kinds = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1])) for d in description}
    for name, kind in result.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} against {kinds[name]}")
    if len(rows) != len(found):
        problems.append(f"{len(found)} rows against {len(rows)}")
    wrong = [(a, b) for a, b in zip(found, rows) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ in {names}, first: {str(wrong[0])[:600]}")
    return problems
