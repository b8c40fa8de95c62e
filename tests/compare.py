"""Runs a query here and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    if isinstance(v, float) and v.is_integer() and not math.isinf(v):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytearray, bytes)):
        return bytes(v).hex()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    mine_names, mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine_names != names:
        return f"columns {mine_names} != {names}"
    if mine != theirs:
        a, b = mine - theirs, theirs - mine
        return (f"{sum(mine.values())} rows vs {sum(theirs.values())}; only here "
                f"{sum(a.values())}: {list(a)[:3]}; only there {sum(b.values())}: {list(b)[:3]}")
    return None
