"""Compare a registered query with its SQL restatement on the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(canonical(r[k]) for k in order) for r in rows)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in cur.fetchall()])


def difference(spark_side, sql_side) -> str | None:
    if spark_side[0] != sql_side[0]:
        return f"columns {spark_side[0]} vs {sql_side[0]}"
    a, b = spark_side[1], sql_side[1]
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)} rows; spark {a[:2]} sql {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None
