"""Mesh, graph and point tables derived from the star-schema tables.

The same SQL runs on Spark (`view`) and, as a common table expression, on any ANSI engine (`with_`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.prefix import running

BASE = ("part", "lineitem", "events", "embeddings", "orders", "customer", "supplier", "nation", "region")

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "mesh_vertices": (
        (),
        """SELECT CAST(p_partkey AS BIGINT) AS vid, CAST(p_partkey % 20 AS DOUBLE) AS x, CAST(floor(p_partkey / 20) AS DOUBLE) AS y,
       CAST(p_size AS DOUBLE) / 10 AS z, CAST((p_partkey * 37) % 256 AS INT) AS r, CAST((p_partkey * 59) % 256 AS INT) AS g,
       CAST((p_partkey * 83) % 256 AS INT) AS b FROM part""",
    ),
    "mesh_faces": (
        ("mesh_vertices",),
        """SELECT 2 * a.vid AS fid, a.vid AS v0, b.vid AS v1, c.vid AS v2
FROM mesh_vertices a JOIN mesh_vertices b ON b.vid = a.vid + 1 AND b.y = a.y JOIN mesh_vertices c ON c.vid = a.vid + 20
UNION ALL
SELECT 2 * a.vid + 1 AS fid, b.vid AS v0, d.vid AS v1, c.vid AS v2
FROM mesh_vertices a JOIN mesh_vertices b ON b.vid = a.vid + 1 AND b.y = a.y JOIN mesh_vertices c ON c.vid = a.vid + 20
JOIN mesh_vertices d ON d.vid = a.vid + 21""",
    ),
    "dag_nodes": (
        (),
        """SELECT CAST(p_partkey AS BIGINT) AS node, 1000.0E0 / (1 + p_partkey) AS error, 100 + p_size * 10 AS nface, 52 + p_size * 5 AS nvert,
       CAST((floor(((52 + p_size * 5) * 12 + (100 + p_size * 10) * 6 - 1) / 256) + 1) * 256 AS BIGINT) AS size_bytes,
       CAST(p_partkey % 20 AS DOUBLE) AS cx, CAST(floor(p_partkey / 20) AS DOUBLE) AS cy, CAST(p_size AS DOUBLE) / 10 AS cz,
       2000.0E0 / (1 + p_partkey) AS radius, 1.0E0 AS tight_radius FROM part""",
    ),
    "dag_patches": (
        ("dag_nodes",),
        """SELECT n.node AS src, k.i AS ordinal, CASE WHEN 2 * n.node + k.i < t.n THEN 2 * n.node + k.i ELSE t.n END AS dst
FROM dag_nodes n CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) k CROSS JOIN (SELECT count(*) AS n FROM part) t
WHERE 2 * n.node + k.i < t.n OR (k.i = 1 AND 2 * n.node + 1 >= t.n)""",
    ),
    "cones": (
        ("dag_nodes",),
        """SELECT node, error, nvert, nface, cx, cy, cz, radius, tight_radius, CAST(CASE node % 4 WHEN 0 THEN 19659 WHEN 1 THEN 0 WHEN 2 THEN 26212 ELSE -19659 END AS INT) AS n0,
       CAST(CASE node % 4 WHEN 0 THEN 26212 WHEN 1 THEN -19659 ELSE 0 END AS INT) AS n1, CAST(CASE node % 4 WHEN 0 THEN 0 WHEN 1 THEN 26212 WHEN 2 THEN 19659 ELSE 26212 END AS INT) AS n2,
       CAST(3276 + (node % 7) * 2000 AS INT) AS n3 FROM dag_nodes""",
    ),
    "node_faces": (
        ("mesh_vertices", "mesh_faces"),
        """SELECT CAST(floor(f.v0 / 100) AS BIGINT) AS node, f.fid, f.v0, f.v1, f.v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2
FROM mesh_faces f JOIN mesh_vertices a ON a.vid = f.v0 JOIN mesh_vertices b ON b.vid = f.v1 JOIN mesh_vertices c ON c.vid = f.v2""",
    ),
    "rough_faces": (
        ("mesh_faces",),
        """SELECT fid, v0, v1, v2 FROM mesh_faces UNION ALL SELECT fid + 1000000000, v1, v2, v0 FROM mesh_faces WHERE fid % 37 = 0
UNION ALL SELECT fid + 2000000000, v0, v0, v1 FROM mesh_faces WHERE fid % 41 = 0 UNION ALL SELECT fid + 3000000000, v0, v1, v0 + 60 FROM mesh_faces WHERE fid % 86 = 0""",
    ),
    "wedges": (
        ("node_faces",),
        """SELECT fid, node, k, vid, chart, (x - 10 * chart) / 10 AS u, y / 100 AS v FROM (
SELECT fid, node, 0 AS k, v0 AS vid, x0 AS x, y0 AS y, CASE WHEN least(x0, x1, x2) >= 10 THEN 1 ELSE 0 END AS chart FROM node_faces UNION ALL
SELECT fid, node, 1, v1, x1, y1, CASE WHEN least(x0, x1, x2) >= 10 THEN 1 ELSE 0 END FROM node_faces UNION ALL
SELECT fid, node, 2, v2, x2, y2, CASE WHEN least(x0, x1, x2) >= 10 THEN 1 ELSE 0 END FROM node_faces)""",
    ),
    "node_vertices": (
        ("node_faces", "mesh_vertices"),
        """SELECT w.node, w.vid, m.x, m.y, m.z, m.r, m.g, m.b, CAST((m.vid * 7919 + w.node * 31) % 2001 - 1000 AS INT) AS nx, CAST((m.vid * 104729 + w.node * 17) % 2001 - 1000 AS INT) AS ny, 32000 AS nz
FROM (SELECT DISTINCT node, vid FROM (SELECT node, v0 AS vid FROM node_faces UNION ALL SELECT node, v1 FROM node_faces UNION ALL SELECT node, v2 FROM node_faces)) w JOIN mesh_vertices m ON m.vid = w.vid""",
    ),
    "node_index": (
        ("dag_nodes", "dag_patches"),
        """SELECT n.node, n.error, n.nvert, n.nface, n.cx, n.cy, n.cz, n.radius, n.tight_radius, n.size_bytes, coalesce(p.patches, 0) AS patches
FROM dag_nodes n LEFT JOIN (SELECT src, count(*) AS patches FROM dag_patches GROUP BY src) p ON p.src = n.node""",
    ),
    "splats": (
        (),
        """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pid,
       l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_suppkey AS node FROM lineitem""",
    ),
    "points": ((), "SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_suppkey AS node FROM lineitem"),
    "tokens": ((), "SELECT event_id, user_id AS node, date_trunc('hour', ts) AS frame, value AS error, event_type FROM events"),
}


def needs(*names: str) -> list[str]:
    """The derived tables with all they are made of, in order of making."""
    out: list[str] = []
    for n in names:
        out += [x for x in [*needs(*SQL[n][0]), n] if x not in out]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived or a given table as a DataFrame; no view is left behind that a later query could meet."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "splats":  # numbered in ranges of the order, where the SQL has one window over all rows
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*order, "l_quantity AS x", "l_discount * 100 AS y", "l_tax * 100 AS z", "l_suppkey AS node")
        return running(rows, order, number="_n").select((F.col("_n") - 1).alias("pid"), "x", "y", "z", "node")
    return run(spark, sf_dir, f"SELECT * FROM {name}")


def with_(sql: str) -> str:
    """sql with the derived tables that it names in front."""
    import re

    ctes = needs(*[n for n in SQL if re.search(rf"\b{n}\b", sql)])
    head = ", ".join(f"{n} AS ({SQL[n][1]})" for n in ctes)
    if not head:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql.lstrip()[14:]}"
    return f"WITH {head}, {sql.lstrip()[4:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {head} {sql}"


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the given and derived tables of sf_dir."""
    import re

    full = with_(sql)
    for t in BASE:
        if re.search(rf"\b{t}\b", full):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(full)
