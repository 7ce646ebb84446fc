"""File round trips and the streaming cache, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..operators import mesh as M
from ..operators import tiers as T
from ..sources import binary as B
from ..sources import meshes as S
from ..sources.lines import scratch
from ..streaming import requests as R
from . import ORACLE_SQL, QUERIES, TRI, query
from .tiers import LAST, ORDER


def _round_trip(t, suffix: str, columns: list[str]):
    """The fixture mesh, written and read again.  Part numbers are gapless from 0."""
    vertices, faces = t("mesh_vertices").select("vid", *columns), t("mesh_faces")
    path = f"{scratch(vertices.sparkSession, 'mesh')}.{suffix}"
    {"obj": S.write_obj, "off": S.write_off, "ply": S.write_ply}[suffix](vertices, faces, path)
    return S.READERS[suffix](vertices.sparkSession, path)


@query("src_06_obj_vertices", "SELECT vid, x, y, z FROM mesh_vertices")
def _(t):
    return _round_trip(t, "obj", [*"xyz"])[0]


# Faces are numbered by their order in the file.
FACES = "SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, v0, v1, v2 FROM mesh_faces"


@query("src_07_obj_faces", FACES)
def _(t):
    return _round_trip(t, "obj", [*"xyz"])[1]


@query("src_24_off_vertices", "SELECT vid, x, y, z FROM mesh_vertices")
def _(t):
    return _round_trip(t, "off", [*"xyz"])[0]


@query("src_24_off_faces", FACES)
def _(t):
    return _round_trip(t, "off", [*"xyz"])[1]


@query("src_03_ply_vertices", "SELECT vid, x, y, z, r, g, b, 255 AS a FROM mesh_vertices")
def _(t):
    return _round_trip(t, "ply", [*"xyzrgb"])[0]


@query("snk_05_ply_faces", FACES)
def _(t):
    return _round_trip(t, "ply", [*"xyzrgb"])[1]


# Binary files, written by every task and read back in ranges of records.
@query("src_01_binary_ply", f"WITH {TRI} SELECT {', '.join(S.SOUP)} FROM tri")
def _(t):
    soup = M.gather(t("mesh_faces"), t("mesh_vertices"))
    spark = soup.sparkSession
    path = "\n".join(B.write_parts(soup, scratch(spark, "ply"), "ply"))
    v, out = B.read_binary(spark, path, "ply", "vertices"), B.read_binary(spark, path, "ply", "faces")
    for k in range(3):
        out = out.join(v.select("file", F.col("vid").alias(f"v{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz")), ["file", f"v{k}"])
    return out.select(*S.SOUP)


@query("src_09_raw_triangles", f"WITH {TRI} SELECT {', '.join(f'CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}' for c in S.SOUP)} FROM tri")
def _(t):
    soup = M.gather(t("mesh_faces"), t("mesh_vertices"))
    path = "\n".join(B.write_parts(soup, scratch(soup.sparkSession, "raw"), "raw"))
    return B.read_binary(soup.sparkSession, path, "raw", "triangles").select(*S.SOUP)


@query("src_24_binary_stl", f"WITH {TRI} SELECT {', '.join(f'CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}' for c in S.SOUP)} FROM tri")
def _(t):
    soup = M.gather(t("mesh_faces"), t("mesh_vertices"))
    path = "\n".join(B.write_parts(soup, scratch(soup.sparkSession, "stl"), "stl"))
    return B.read_binary(soup.sparkSession, path, "stl", "triangles").select(*S.SOUP)


@query("src_24_stl_soup", f"WITH {TRI} SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, {', '.join(S.SOUP)} FROM tri")
def _(t):
    soup = M.gather(t("mesh_faces"), t("mesh_vertices")).select("fid", *S.SOUP)
    path = scratch(soup.sparkSession, "mesh") + ".stl"
    S.write_stl(soup, path)
    return S.read_stl_text(soup.sparkSession, path)


@query("src_12_models", f"WITH f AS ({FACES}) SELECT 0 AS model, count(*) AS faces FROM f UNION ALL SELECT 1, count(*) FROM f")
def _(t):
    vertices, faces = t("mesh_vertices").select("vid", *"xyz"), t("mesh_faces")
    top = scratch(vertices.sparkSession, "models")
    S.write_obj(vertices, faces, f"{top}/a.obj")
    S.write_off(vertices, faces, f"{top}/b.off")
    return S.read_models(vertices.sparkSession, [f"{top}/a.obj", f"{top}/b.off"])[1].groupBy("model").agg(F.count("*").alias("faces"))


def streamed(spark, sf_dir):
    """Nodes resident after all requests came as a stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream's plain path must be a folder; a pattern may also name one file.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    requests = events.select(F.col("user_id").alias("node"), F.date_trunc("hour", "ts").alias("frame"), F.col("value").alias("error"))
    top = scratch(spark, "requests")
    R.follow(requests, f"{top}/table", f"{top}/checkpoint", once=True).awaitTermination()
    last = R.priorities(spark, f"{top}/table").withColumn("size", 1000 + F.col("node") % 7 * 100)
    return T.resident(last, 30_000).select("node", "held")


QUERIES["str_10_streamed_resident"] = streamed
ORACLE_SQL["str_10_streamed_resident"] = fixtures.with_(f"WITH {LAST} SELECT node, held FROM (SELECT node, CAST(sum(size) OVER ({ORDER}) AS BIGINT) AS held FROM last) WHERE held <= 30000")
