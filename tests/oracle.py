"""Compares a query with its SQL on the given tables, as sorted rows of plain values."""

from __future__ import annotations

import datetime as dt
import decimal
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def differences(spark, query, sql: str, data: Path = DATA) -> list:
    """Rows that only one side has, at most a few, and the columns if they differ; empty if both agree."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(data.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    df = query(spark, str(data))
    if sorted(df.columns) != sorted(names):
        return [sorted(df.columns), sorted(names)]
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in (x.asDict(recursive=True) for x in df.collect())), key=repr)
    if got == want:
        return []
    a, b = set(map(repr, got)), set(map(repr, want))
    return [f"{len(got)} and {len(want)} rows", *sorted(a - b)[:3], *sorted(b - a)[:3]]
