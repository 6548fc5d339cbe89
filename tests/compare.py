"""Comparing a query with its SQL."""

from __future__ import annotations

import math
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def views(folder: Path = DATA):
    import duckdb

    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.13g}" if isinstance(value, float) else str(value)


def same_rows(spark, con, query, sql, folder: Path = DATA) -> None:
    frame = query(spark, str(folder))
    columns = sorted(frame.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert ours == theirs
