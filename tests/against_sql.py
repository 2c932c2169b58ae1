"""Compares a query's rows with those of its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(value):
    if isinstance(value, dict):
        return tuple((str(k), _plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    return float(value) if isinstance(value, Decimal) else bytes(value) if isinstance(value, bytearray) else value


def _order(row) -> str:
    """Rows are paired by all but the last digits of their numbers."""
    return repr(tuple(float(f"{x:.4g}") if isinstance(x, float) else x for x in row))


def _same(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def differences(spark, query, sql: str, sf_dir: str) -> list:
    """Up to three differing pairs of rows; none where the results are equal."""
    found = query(spark, sf_dir)
    names = sorted(found.columns)
    ours = sorted((_plain(tuple(r[c] for c in names)) for r in found.collect()), key=_order)
    db = database(sf_dir)
    told = db.execute(sql)
    heads = [x[0] for x in told.description]
    if sorted(heads) != names:
        return [(names, sorted(heads))]
    at = [heads.index(c) for c in names]
    theirs = sorted((_plain(tuple(r[i] for i in at)) for r in told.fetchall()), key=_order)
    db.close()
    if len(ours) != len(theirs):
        return [(len(ours), len(theirs))]
    return [(a, b) for a, b in zip(ours, theirs, strict=True) if not _same(a, b)][:3]
