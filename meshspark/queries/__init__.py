"""Registered queries by topic; each has a Spark form and a SQL form over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Triangles with their corners' coordinates, for the SQL side.
TRI = """tri AS (SELECT f.fid, f.v0, f.v1, f.v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2
FROM mesh_faces f JOIN mesh_vertices a ON a.vid = f.v0 JOIN mesh_vertices b ON b.vid = f.v1 JOIN mesh_vertices c ON c.vid = f.v2)"""


def query(name: str, sql: str | None):
    """Register a function of (tables) under name; sql None where SQL can't express it."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: fixtures.table(spark, sf_dir, t))
        if sql is not None:
            ORACLE_SQL[name] = fixtures.with_(sql)
        return f

    return register


def register_scalar(columns: Callable[[str], dict], name: str, table: str, key: str, made: dict[str, tuple[object, str]], where: str | None = None) -> None:
    """Register columns computed row by row: name -> (Spark column, SQL expression).

    Columns are made when the query runs, as they need a session.
    """
    cond = f" WHERE {where}" if where else ""
    sql = f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, (_, e) in made.items())} FROM {table}{cond}"

    @query(name, sql)
    def _(t: Tables) -> DataFrame:
        df = t(table).where(where) if where else t(table)
        return df.select(key, *(c.alias(n) for n, (c, _) in columns(name).items()))


def rowwise(name: str, table: str, key: str, columns: Callable[[], dict], sql: dict[str, str]) -> None:
    """Register columns computed row by row: name -> Spark column, made when the query runs, and name -> SQL."""

    @query(name, f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {table}")
    def _(t: Tables) -> DataFrame:
        made = columns()
        return t(table).select(key, *(made[n].alias(n) for n in sql))


from . import catalogue, cloud, container, dag, files, mesh, nodes, points, scalars, shapes, surfaces, tiers, view, windows  # noqa: E402, F401
