"""Mesh files: OBJ, OFF, PLY and STL as text, PLY, STL and raw triangles as binary.

Readers give vertices (vid, x, y, z, and r, g, b, a where the format has colours) and faces (fid, v0, v1,
v2), or a soup of triangles (fid, x0 .. z2).  Text is read in splits of any size, binary files in ranges of
records (`binary`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import COLOURS, read_binary
from .lines import numbered, save, words

SOUP = [f"{c}{k}" for k in range(3) for c in "xyz"]

Mesh = tuple[DataFrame, DataFrame]


def read_obj(spark: SparkSession, path: str) -> Mesh:
    """Vertices and triangles; indices are one-based, of forms i, i/j, i/j/k and i//k."""
    rows = numbered(spark, path).withColumn("w", words())
    of = lambda tag: rows.where(F.col("w")[0] == tag)
    v, f = _renumber(of("v")), _renumber(of("f"))
    vertices = v.select(F.col("n").alias("vid"), *(_number(F.get("w", F.lit(k + 1)), F.col("w")).alias(c) for k, c in enumerate("xyz")))
    faces = f.select(F.col("n").alias("fid"), *((F.split(x, "/")[0].cast("long") - 1).alias(f"v{k}") for k, x in enumerate(_corners(F.col("w"), F.size("w") - 1, 1))))
    return vertices, faces


def _corners(row: Column, count: Column, first: int) -> list[Column]:
    """Three corner words of a face line; a face of another number of corners, or a word that is missing, is an error."""
    bad = F.raise_error(F.concat(F.lit("not a triangle: "), F.concat_ws(" ", row))).cast("string")
    return [F.when((count == 3) & (F.size(row) >= first + 3), row[first + k]).otherwise(bad) for k in range(3)]


def _number(word: Column, row: Column) -> Column:
    """A coordinate; anything else is an error."""
    bad = F.raise_error(F.concat(F.lit("no coordinate in: "), F.concat_ws(" ", row))).cast("double")
    return F.coalesce(word.try_cast("double"), bad)


def _renumber(rows: DataFrame) -> DataFrame:
    """n from 0 in order of lines."""
    from ..operators.prefix import running

    return running(rows, ["line"], number="n").withColumn("n", F.col("n") - 1)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    v = vertices.select(F.lit(0).alias("block"), F.col("vid").alias("id"), F.concat_ws(" ", F.lit("v"), *_numbers("xyz")).alias("value"))
    f = faces.select(F.lit(1).alias("block"), F.col("fid").alias("id"), F.concat_ws(" ", F.lit("f"), *((F.col(f"v{k}") + 1).cast("string") for k in range(3))).alias("value"))
    save(v.unionAll(f), path)


def _numbers(columns) -> list:
    return [F.col(c).cast("string") for c in columns]


def read_off(spark: SparkSession, path: str) -> Mesh:
    """Lines of OFF without comments and blanks: magic, counts, vertices, triangles."""
    plain = numbered(spark, path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    rows = _renumber(plain).withColumn("w", words())
    head = rows.where("n = 1").first()
    if head is None:
        raise ValueError(f"no OFF header in {path}")
    nv, nf = int(head["w"][0]), int(head["w"][1])
    v, f = rows.where(F.col("n").between(2, nv + 1)), rows.where(F.col("n").between(nv + 2, nv + nf + 1))
    vertices = v.select((F.col("n") - 2).alias("vid"), *(F.col("w")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return vertices, f.select((F.col("n") - 2 - nv).alias("fid"), *(x.cast("long").alias(f"v{k}") for k, x in enumerate(_corners(F.col("w"), F.col("w")[0].cast("int"), 1))))


def _counts(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row (nv, nf), counted on the executors."""
    return vertices.agg(F.count("*").alias("nv")).crossJoin(faces.agg(F.count("*").alias("nf")))  # one row each


def _body(vertices: DataFrame, faces: DataFrame, columns) -> DataFrame:
    """Vertex and face lines as OFF and PLY have them; a face's indices are places in order of vid, from 0."""
    v = vertices.select(F.lit(1).alias("block"), F.col("vid").alias("id"), F.concat_ws(" ", *_numbers(columns)).alias("value"))
    f = faces.select(F.lit(2).alias("block"), F.col("fid").alias("id"), F.concat_ws(" ", F.lit("3"), *_numbers(["v0", "v1", "v2"])).alias("value"))
    return v.unionAll(f)


def write_off(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """vid must be gapless from 0."""
    lines = F.array(F.lit("OFF"), F.concat_ws(" ", "nv", "nf", F.lit("0")))
    head = _counts(vertices, faces).select(F.lit(0).alias("block"), F.posexplode(lines).alias("id", "value"))
    save(head.withColumn("id", F.col("id").cast("long")).unionAll(_body(vertices, faces, "xyz")), path)


def write_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """Text PLY, with colours where the vertices have r, g, b.  vid must be gapless from 0."""
    colours = [c for c in "rgba" if c in vertices.columns]
    props = [f"property double {c}" for c in "xyz"] + [f"property uchar {COLOURS[c][0]}" for c in colours]
    before, behind = ["ply", "format ascii 1.0"], ["property list uchar int vertex_indices", "end_header"]
    lines = F.array(*map(F.lit, before), F.concat(F.lit("element vertex "), F.col("nv").cast("string")), *map(F.lit, props), F.concat(F.lit("element face "), F.col("nf").cast("string")), *map(F.lit, behind))
    head = _counts(vertices, faces).select(F.lit(0).alias("block"), F.posexplode(lines).alias("id", "value"))
    save(head.withColumn("id", F.col("id").cast("long")).unionAll(_body(vertices, faces, [*"xyz", *colours])), path)


def ply_elements(header: list[str]) -> tuple[str, list[tuple[str, int, list[tuple[str, ...]]]]]:
    """(format, [(element, rows, [(name, type) or (name, count type, item type)])])."""
    kind, elements = "", []
    for w in (line.split() for line in header):
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], *w[2:-1]) if w[1] == "list" else (w[-1], w[1]))
    return kind, elements


def read_ply_text(spark: SparkSession, path: str) -> Mesh:
    rows = numbered(spark, path)
    end = rows.where(F.trim("value") == "end_header").agg(F.min("line").alias("n")).first()["n"]
    if end is None:
        raise ValueError(f"no PLY header in {path}")
    header = [r["value"] for r in rows.where(F.col("line") <= end).orderBy("line").collect()]
    start, found = end + 1, {}
    for name, n, props in ply_elements(header)[1]:
        found[name] = (rows.where(F.col("line").between(start, start + n - 1)).select((F.col("line") - start).alias("n"), words().alias("w")), [p[0] for p in props])
        start += n
    body, names = found["vertex"]
    cols = [F.col("w")[names.index(c)].cast("double").alias(c) for c in "xyz"]
    tint = {c: next((names.index(x) for x in known if x in names), None) for c, known in COLOURS.items()}
    if tint["r"] is not None:
        cols += [(F.lit(255) if i is None else F.col("w")[i].cast("int")).alias(c) for c, i in tint.items()]
    vertices = body.select(F.col("n").alias("vid"), *cols)
    if "face" not in found:
        return vertices, spark.createDataFrame([], "fid long, v0 long, v1 long, v2 long")
    return vertices, found["face"][0].select(F.col("n").alias("fid"), *(x.cast("long").alias(f"v{k}") for k, x in enumerate(_corners(F.col("w"), F.col("w")[0].cast("int"), 1))))


def read_ply_binary(spark: SparkSession, path: str) -> Mesh:
    """Vertices and faces of binary PLY files, in ranges of records; `file` tells models apart."""
    return read_binary(spark, path, "ply", "vertices"), read_binary(spark, path, "ply", "faces")


def write_stl(soup: DataFrame, path: str) -> None:
    """Text STL of (fid, x0 .. z2); normals are written as zeros, which readers take as not given."""
    corner = [F.concat_ws(" ", F.lit("vertex"), *_numbers([f"{c}{k}" for c in "xyz"])) for k in range(3)]
    lines = F.array(F.lit("facet normal 0 0 0"), F.lit("outer loop"), *corner, F.lit("endloop"), F.lit("endfacet"))
    body = soup.select(F.lit(1).alias("block"), F.col("fid"), F.posexplode(lines).alias("k", "value")).select("block", (F.col("fid") * 7 + F.col("k")).alias("id"), "value")
    ends = soup.sparkSession.createDataFrame([(0, 0, "solid mesh"), (2, 0, "endsolid mesh")], "block int, id long, value string")
    save(ends.unionAll(body), path)


def read_stl_text(spark: SparkSession, path: str) -> DataFrame:
    """(fid, x0 .. z2): each three vertex lines are a triangle."""
    v = _renumber(numbered(spark, path).where(F.trim("value").startswith("vertex ")).withColumn("w", words()))
    k = F.col("n") % 3
    cols = [F.max(F.when(k == j, F.col("w")[i + 1].cast("double"))).alias(f"{c}{j}") for j in range(3) for i, c in enumerate("xyz")]
    return v.groupBy(F.floor(F.col("n") / 3).alias("fid")).agg(*cols)


def read_stl_binary(spark: SparkSession, path: str) -> DataFrame:
    """(file, fid, x0 .. z2)."""
    return read_binary(spark, path, "stl", "triangles")


def read_raw_triangles(spark: SparkSession, path: str) -> DataFrame:
    """(file, fid, x0 .. z2, r0 .. b2) of records of 27 floats: positions, normals, colours from 0 to 1."""
    return read_binary(spark, path, "raw", "triangles")


READERS = {"obj": read_obj, "off": read_off, "ply": read_ply_text}


def read_models(spark: SparkSession, paths: list[str]) -> Mesh:
    """Several files by suffix (obj, off, ply) as one pair of tables, with `model` from 0 in order of paths.

    Colours are null where a file has none.
    """
    read = [(k, READERS[p.rstrip("/").rsplit(".", 1)[-1].lower()](spark, p)) for k, p in enumerate(paths)]
    vertices, faces = zip(*([d.withColumn("model", F.lit(k)) for d in pair] for k, pair in read), strict=True)
    return tuple(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), t) for t in (vertices, faces))
