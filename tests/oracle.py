"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sort_key(row):
    return [(v is None, str(type(v)), f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row]


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when names, types and values agree."""
    problems = []
    got = df.toArrow()
    want = con.execute(sql).to_arrow_table()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return [f"columns {names} != {sorted(want.column_names)}"]
    for name in names:
        a, b = str(got.schema.field(name).type), str(want.schema.field(name).type)
        if a != b:
            problems.append(f"type of {name}: spark {a}, sql {b}")
    left = sorted(
        ([_norm(v) for v in r.values()] for r in got.select(names).to_pylist()), key=_sort_key
    )
    right = sorted(
        ([_norm(v) for v in r.values()] for r in want.select(names).to_pylist()), key=_sort_key
    )
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        problems.append(f"{len(bad)} of {len(left)} rows differ, first: {dict(zip(names, zip(*bad[0])))}")
    return problems
