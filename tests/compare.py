"""Row-for-row comparison of a query with its SQL on the same Parquet files."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if f != f else repr(f + 0.0)
    return str(v)


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(map(_value, r)) for r in zip(*cols, strict=True)), names


def differences(spark_df, con, sql: str) -> str:
    """Empty if equal."""
    got, names = rows(spark_df.toArrow())
    want, wanted = rows(con.execute(sql).to_arrow_table())
    if names != wanted:
        return f"columns {names} and {wanted}"
    if got == want:
        return ""
    bad = next(((a, b) for a, b in zip(got, want) if a != b), None)
    return f"{len(got)} and {len(want)} rows; first difference {bad}"
