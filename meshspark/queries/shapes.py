"""Shapes: boxes, spheres, quadrics, packed values, intersections and distances, over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import colour as C
from ..functions import distances as D
from ..functions import geometry as G
from ..functions import intersect as X
from . import query, rowwise
from .scalars import _morton_sql, big

c = F.col
center = lambda: (c("cx"), c("cy"), c("cz"))
corners = lambda: tuple(G.vec(suffix=str(k)) for k in range(3))
point = lambda *v: tuple(F.lit(float(x)) for x in v)
r4 = lambda v: F.round(v, 4)

# Boxes of a node's tight sphere, against the fixed box (5, 4, 0) to (12, 30, 3).
LOW, HIGH = (5.0, 4.0, 0.0), (12.0, 30.0, 3.0)
_lo = [f"(c{a} - tight_radius)" for a in "xyz"]
_hi = [f"(c{a} + tight_radius)" for a in "xyz"]
rowwise(
    "fn_m20_box_algebra", "dag_nodes", "node",
    lambda: {
        "add_x": F.greatest(c("cx") + c("tight_radius"), F.lit(HIGH[0])), "cut_x": F.greatest(c("cx") - c("tight_radius"), F.lit(LOW[0])), "cut_y": F.least(c("cy") + c("tight_radius"), F.lit(HIGH[1])),
        "meets": G.boxes_meet(*G.around(center(), c("tight_radius")), point(*LOW), point(*HIGH)), "diagonal": r4(G.box_diagonal(*G.around(center(), c("tight_radius")))),
        "volume": r4(G.box_volume(*G.around(center(), c("tight_radius") + 0.5))), "mid_y": (c("cy") + c("tight_radius") + c("cy") - c("tight_radius")) / 2, "holds": G.in_box(center(), LOW, HIGH),
    },
    {
        "add_x": "greatest(cx + tight_radius, 12.0)", "cut_x": "greatest(cx - tight_radius, 5.0)", "cut_y": "least(cy + tight_radius, 30.0)",
        "meets": " AND ".join(f"{_lo[i]} <= {HIGH[i]} AND {_hi[i]} >= {LOW[i]}" for i in range(3)), "diagonal": "round(2 * tight_radius * sqrt(3.0::DOUBLE), 4)",
        "volume": "round(power(2 * tight_radius + 1, 3), 4)", "mid_y": "cy", "holds": " AND ".join(f"c{a} >= {LOW[i]} AND c{a} < {HIGH[i]}" for i, a in enumerate("xyz")),
    },
)
_D = "sqrt((cx - 10) * (cx - 10) + (cy - 10) * (cy - 10) + (cz - 2) * (cz - 2))"
rowwise(
    "fn_m21_sphere_algebra", "dag_nodes", "node",
    lambda: {
        "holds_point": X.sphere_point_distance(center(), c("radius"), point(10, 10, 2)) == 0, "holds_sphere": G.norm(G.sub(center(), point(10, 10, 2))) + 3 <= c("radius"),
        "meets": X.sphere_sphere(center(), c("radius"), point(10, 10, 2), F.lit(3.0)), "grown": r4(G.sphere_add(center(), c("radius"), point(10, 10, 2), F.lit(3.0))[1]), "moved": r4(G.sphere_add(center(), c("radius"), point(10, 10, 2), F.lit(3.0))[0][0]),
    },
    {
        "holds_point": f"{_D} <= radius", "holds_sphere": f"{_D} + 3 <= radius", "meets": f"{_D} <= radius + 3",
        "grown": f"round(CASE WHEN {_D} + 3 <= radius THEN radius WHEN {_D} + radius <= 3 THEN 3 ELSE ({_D} + radius + 3) / 2 END, 4)",
        "moved": f"round(CASE WHEN {_D} + 3 <= radius THEN cx WHEN {_D} + radius <= 3 THEN 10 ELSE cx + (10 - cx) * (({_D} + 3 - radius) / 2 / {_D}) END, 4)",
    },
)


@query("fn_m22_quadric", """WITH n AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS a, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS b, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS g FROM node_faces),
u AS (SELECT *, sqrt(a * a + b * b + g * g) AS l FROM n WHERE a * a + b * b + g * g > 0), p AS (SELECT node, v0, v1, v2, a / l AS a, b / l AS b, g / l AS g, -(a * x0 + b * y0 + g * z0) / l AS d FROM u),
v AS (SELECT v0 AS vid, * FROM p UNION ALL SELECT v1, * FROM p UNION ALL SELECT v2, * FROM p)
SELECT q.vid, round(sum(power(q.a * (m.x + 0.25) + q.b * (m.y + 0.25) + q.g * (m.z + 0.25) + q.d, 2)), 4) AS error FROM v q JOIN mesh_vertices m ON m.vid = q.vid GROUP BY q.vid""")
def _(t):
    """Each vertex's quadric, the sum of its faces' planes, applied a little beside the vertex."""
    from ..operators import quadrics as Q

    q = Q.vertex_quadrics(t("node_faces")).join(t("mesh_vertices").select("vid", *"xyz"), "vid")
    p = tuple(c(a) + 0.25 for a in "xyz")
    return q.select("vid", F.round(Q.apply(p), 4).alias("error"))


@query("fn_m22_quadric_minimum", None)
def _(t):
    """Where each face's three planes' quadrics add up to least: (fid, x, y, z), null where no one point is best."""
    from ..operators import quadrics as Q

    q = Q.vertex_quadrics(t("node_faces"))
    x, y, z = Q.minimum()
    return q.select("vid", *(F.round(v, 3).alias(n) for n, v in zip("xyz", (x, y, z), strict=True)))


rowwise("fn_m15_cone_pack", "cones", "node",
    lambda: dict(zip(("a", "b", "k", "w"), G.pack_cone(tuple(c(f"n{i}") / 16383.0 for i in range(3))), strict=True)),
    {**{n: f"CAST(trunc(greatest(least(n{i} / 16383.0::DOUBLE / sqrt((n0 * n0 + n1 * n1 + n2 * n2) / (16383.0::DOUBLE * 16383.0)), 1.0), -1.0) * 32766) AS INT)" for i, n in enumerate("abk")}, "w": "CAST(trunc(least(sqrt((n0 * n0 + n1 * n1 + n2 * n2) / (16383.0::DOUBLE * 16383.0)), 10.0) * 3276) AS INT)"},
)
rowwise("fn_m17_normal_z", "cones", "node", lambda: {"z": G.normal_z(c("n0"), c("n1"), c("node") % 2)}, {"z": "CAST(trunc(sqrt(greatest(32767.0::DOUBLE * 32767 - n0 * n0 - n1 * n1, 0.0)) * CASE WHEN node % 2 = 1 THEN -1 ELSE 1 END) AS INT)"})


@query("fn_b03_morton_decode", f"SELECT pid, {', '.join(f'CAST(trunc({a}) AS BIGINT) & 63 AS d{a}' for a in 'xyz')} FROM splats")
def _(t):
    cell = [F.floor(c(a)).cast("long") for a in "xyz"]
    m = B.morton(*cell, 6)
    return t("splats").select("pid", *(B.morton_axis(m, k, 6).alias(f"d{a}") for k, a in enumerate("xyz")))


rowwise("fn_b04_morton_2d", "dag_nodes", "node", lambda: {a: B.morton_axis(c("node"), k, 8, 2) for k, a in enumerate("uv")}, {a: " | ".join(f"(((node >> {2 * i + k}) & 1) << {i})" for i in range(8)) for k, a in enumerate("uv")})
rowwise("cod_04_residual_class", "dag_nodes", "node", lambda: {"class": B.ilog2(B.zigzag(c("node") - 300) + 1), "rest": B.residual_bits(c("node") - 300)}, {
    "class": "CAST(length(bin((CASE WHEN node < 300 THEN -2 * (node - 300) - 1 ELSE 2 * (node - 300) END) + 1)) - 1 AS INT)",
    "rest": big("(CASE WHEN node < 300 THEN -2 * (node - 300) - 1 ELSE 2 * (node - 300) END) + 1 - power(2, length(bin((CASE WHEN node < 300 THEN -2 * (node - 300) - 1 ELSE 2 * (node - 300) END) + 1)) - 1)")})
_HUE = "(vid % 60 / 10.0::DOUBLE)"
rowwise("fn_c06_hsv", "mesh_vertices", "vid", lambda: {n: r4(v) for n, v in zip("efh", C.hsv(c("vid") % 60 / 60.0, c("g") / 256.0, c("b") / 256.0), strict=True)}, {
    n: f"round(CASE CAST(floor({_HUE}) AS INT) % 6 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(row)) + " END, 4)"
    for n, row in zip("efh", zip(*[[{"v": "b / 256.0::DOUBLE", "p": "b / 256.0::DOUBLE * (1 - g / 256.0::DOUBLE)", "q": f"b / 256.0::DOUBLE * (1 - g / 256.0::DOUBLE * ({_HUE} - floor({_HUE})))", "t": f"b / 256.0::DOUBLE * (1 - g / 256.0::DOUBLE * (1 - ({_HUE} - floor({_HUE}))))"}[x] for x in s] for s in ("vtp", "qvp", "pvt", "pqv", "tpv", "vpq")], strict=True), strict=True)})
_W = {(a, b, k): f"nvert * {12 + 6 * a + 4 * b + 8 * k} + nface * 6" for a in (0, 1) for b in (0, 1) for k in (0, 1)}
rowwise("prj_10_row_width", "dag_nodes", "node", lambda: {f"w{a}{b}{k}": G.payload_size(c("nvert"), c("nface"), bool(a), bool(b), bool(k)) for a, b, k in _W}, {f"w{a}{b}{k}": e for (a, b, k), e in _W.items()})
rowwise("prj_11_column_offsets", "dag_nodes", "node", lambda: dict(zip(("coords", "uv", "normals", "colours", "faces"), G.payload_offsets(c("nvert"), True, True, True), strict=True)),
    {"coords": big("0"), "uv": big("nvert * 12"), "normals": big("nvert * 20"), "colours": big("nvert * 26"), "faces": big("nvert * 30")})
rowwise("prj_12_widths", "region", "r_regionkey", lambda: {"vertex": F.lit(G.element_width(["float3", "short3", "ubyte4", "float2"])), "face": F.lit(G.element_width(["ushort3"]))}, {"vertex": "30", "face": "6"})
_M = "string_split('1:0:0:' || p_size || ':0:1:0:0:0:0:1:0:0:0:0:1', ':')"
rowwise("prj_14_matrix_literal", "part", "p_partkey", lambda: {"shift": G.matrix_of(F.concat(F.lit("1:0:0:"), c("p_size"), F.lit(":0:1:0:0:0:0:1:0:0:0:0:1")))[3], "n": F.size(G.matrix_of(F.concat(F.lit("1:0:0:"), c("p_size"), F.lit(":0:1:0:0:0:0:1:0:0:0:0:1"))))}, {"shift": f"CAST({_M}[4] AS DOUBLE)", "n": f"CAST(len({_M}) AS INT)"})
rowwise("fn_s04_matrix_split", "part", "p_partkey", lambda: {"total": F.aggregate(G.matrix_of(F.concat_ws(":", *([c("p_size").cast("string")] * 16))), F.lit(0.0), lambda a, x: a + x)}, {"total": "CAST(p_size * 16 AS DOUBLE)"})
rowwise("prj_19_debug_colour", "dag_nodes", "node", lambda: {n: v for n, v in zip("rgb", C.debug_colour(c("node")), strict=True)}, {"r": "node % 16 * 135 % 127 + 127", "g": "node % 7 * 57 % 127 + 127", "b": "node % 11 * 171 % 63 + 63"})
_P = "(log2(nullif(abs(2 * tight_radius), 0)) - log2(nullif(abs(c{}), 0)) + 24)"
_BITS = f"least({', '.join('coalesce(' + _P.format(a) + ', 1e9)' for a in 'xyz')})"
rowwise("flt_16_float_precision", "dag_nodes", "node", lambda: {"bits": r4(G.float_precision(center(), (2 * c("tight_radius"),) * 3)), "verdict": G.precision_verdict(G.float_precision(center(), (2 * c("tight_radius"),) * 3))},
    {"bits": f"round({_BITS}, 4)", "verdict": f"CASE WHEN {_BITS} < 12 THEN 'refuse' WHEN {_BITS} < 16 THEN 'warn' ELSE 'fine' END"})
rowwise("fn_s06_scheme", "pages", "page_id", lambda: {"http": c("url").startswith("http://"), "https": c("url").startswith("https://"), "rest": F.regexp_replace("url", "^(https?|file)://", "")},
    {"http": "starts_with(url, 'http://')", "https": "starts_with(url, 'https://')", "rest": "regexp_replace(url, '^(https?|file)://', '')"})


@query("fn_s01_header_textures", "SELECT p_partkey, 'tex' || p_size || '.png' AS texture, 0 AS place FROM part UNION ALL SELECT p_partkey, p_brand || '.jpg', 1 FROM part WHERE p_size % 2 = 0")
def _(t):
    more = F.when(c("p_size") % 2 == 0, F.concat(F.lit("comment TextureFile "), c("p_brand"), F.lit(".jpg\n"))).otherwise(F.lit("comment made by hand\n"))
    header = F.concat(F.lit("ply\nformat ascii 1.0\ncomment TextureFile tex"), c("p_size"), F.lit(".png\n"), more, F.lit("element vertex 3\nend_header\n"))
    found = F.regexp_extract_all(header, F.lit(r"comment TextureFile ([^\n]+)"), F.lit(1))
    return t("part").select("p_partkey", F.posexplode(found).alias("place", "texture"))


# ---- intersections and distances of every face with fixed shapes
rowwise("vo_01_line_sphere", "dag_nodes", "node", lambda: {n: r4(v) for n, v in zip(("first", "last"), X.line_sphere(point(0, 0, 1), point(0.6, 0.8, 0), center(), 3 * c("tight_radius")), strict=True)},
    {n: f"round(CASE WHEN 9 * tight_radius * tight_radius - (cx * cx + cy * cy + (cz - 1) * (cz - 1) - power(cx * 0.6 + cy * 0.8, 2)) >= 0 THEN cx * 0.6 + cy * 0.8 {s} sqrt(greatest(9 * tight_radius * tight_radius - (cx * cx + cy * cy + (cz - 1) * (cz - 1) - power(cx * 0.6 + cy * 0.8, 2)), 0)) END, 4)" for n, s in (("first", "-"), ("last", "+"))})
rowwise("vo_03_plane_line", "node_faces", "fid", lambda: {"t": r4(X.plane_line(point(0.6, 0.8, 0), F.lit(9.0), corners()[0], G.sub(corners()[1], corners()[0])))},
    {"t": "round(CASE WHEN abs(0.6 * (x1 - x0) + 0.8 * (y1 - y0)) > 1e-12 THEN (9 - 0.6 * x0 - 0.8 * y0) / (0.6 * (x1 - x0) + 0.8 * (y1 - y0)) END, 4)"})
rowwise("vo_05_plane_segment", "node_faces", "fid", lambda: {"hit": X.plane_segment(point(0, 0, 1), F.lit(2.05), corners()[0], corners()[1]).isNotNull()}, {"hit": "z0 <> z1 AND (z0 - 2.05) * (z1 - 2.05) <= 0"})
rowwise("vo_06_plane_segment_within", "node_faces", "fid", lambda: {"t": r4(X.plane_segment_within(point(0, 0, 1), F.lit(2.05), corners()[0], corners()[1], 0.1))},
    {"t": "round(CASE WHEN least(abs(z0 - 2.05), abs(z1 - 2.05)) < 0.1 THEN CASE WHEN abs(z0 - 2.05) <= abs(z1 - 2.05) THEN 0.0 ELSE 1.0 END WHEN (z0 - 2.05) * (z1 - 2.05) < 0 THEN (z0 - 2.05) / (z0 - z1) END, 4)"})
rowwise("vo_07_plane_triangle", "node_faces", "fid", lambda: {"hit": X.plane_triangle(point(0, 0, 1), F.lit(2.05), corners())}, {"hit": "least(z0, z1, z2) <= 2.05 AND greatest(z0, z1, z2) >= 2.05"})
rowwise("vo_16_plane_box", "dag_nodes", "node", lambda: {"hit": X.plane_box(point(0.6, -0.8, 0), F.lit(1.0), *G.around(center(), c("tight_radius")))}, {"hit": "0.6 * (cx - tight_radius) - 0.8 * (cy + tight_radius) <= 1 AND 0.6 * (cx + tight_radius) - 0.8 * (cy - tight_radius) >= 1"})
rowwise("vo_18_sphere_sphere", "dag_nodes", "node", lambda: {"hit": X.sphere_sphere(center(), c("tight_radius"), point(10, 20, 2), F.lit(6.0))}, {"hit": "sqrt(power(cx - 10, 2) + power(cy - 20, 2) + power(cz - 2, 2)) <= tight_radius + 6"})
rowwise("vo_19_plane_plane", "mesh_vertices", "vid", lambda: dict(zip(("a", "b", "k"), map(r4, X.plane_plane(G.vec(), point(1, 2, 3))), strict=True)), {"a": "round(y * 3 - z * 2, 4)", "b": "round(z * 1 - x * 3, 4)", "k": "round(x * 2 - y * 1, 4)"})
rowwise("vo_20_sphere_distances", "dag_nodes", "node", lambda: {"point": r4(X.sphere_point_distance(center(), c("tight_radius"), point(3, 4, 1))), "sphere": r4(X.sphere_sphere_distance(center(), c("tight_radius"), point(3, 4, 1), F.lit(2.0)))},
    {"point": "round(greatest(sqrt(power(cx - 3, 2) + power(cy - 4, 2) + power(cz - 1, 2)) - tight_radius, 0), 4)", "sphere": "round(greatest(sqrt(power(cx - 3, 2) + power(cy - 4, 2) + power(cz - 1, 2)) - tight_radius - 2, 0), 4)"})
rowwise("vo_22_plane_point", "mesh_vertices", "vid", lambda: {"d2": r4(X.plane_point2(point(1, 2, 2), F.lit(6.0), G.vec()))}, {"d2": "round(power(x + 2 * y + 2 * z - 6, 2) / 9, 4)"})
rowwise("vo_23_line_point", "mesh_vertices", "vid", lambda: {"d2": r4(X.line_point2(point(1, 0, 0), point(0, 2, 0), G.vec())), "d": r4(F.sqrt(X.line_point2(point(1, 0, 0), point(0, 2, 0), G.vec())))}, {"d2": "round(power(x - 1, 2) + z * z, 4)", "d": "round(sqrt(power(x - 1, 2) + z * z), 4)"})
rowwise("vo_26_segment_point", "mesh_vertices", "vid", lambda: {"d2": r4(X.segment_point2(point(2, 3, 0), point(2, 9, 0), G.vec())), "d": r4(F.sqrt(X.segment_point2(point(2, 3, 0), point(2, 9, 0), G.vec())))}, {
    "d2": "round(power(x - 2, 2) + power(y - greatest(3, least(9, y)), 2) + z * z, 4)", "d": "round(sqrt(power(x - 2, 2) + power(y - greatest(3, least(9, y)), 2) + z * z), 4)"})
_S = [f"sqrt(power(x{(i + 1) % 3} - x{i}, 2) + power(y{(i + 1) % 3} - y{i}, 2) + power(z{(i + 1) % 3} - z{i}, 2))" for i in range(3)]
_A2 = "sqrt(power((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + power((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + power((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2))"


@query("vo_32_quality", f"WITH s AS (SELECT fid, {_S[0]} AS a, {_S[1]} AS b, {_S[2]} AS k, {_A2} AS area2 FROM node_faces) SELECT fid, round(area2 / power(greatest(a, b, k), 2), 4) AS longest, round(4 * area2 * area2 / (a * b * k * (a + b + k)), 4) AS radii, round(2 * sqrt(3.0::DOUBLE) * area2 / (a * a + b * b + k * k), 4) AS mean FROM s")
def _(t):
    p = corners()
    return t("node_faces").select("fid", r4(X.quality(p)).alias("longest"), r4(X.quality_radii(p)).alias("radii"), r4(X.quality_mean_ratio(p)).alias("mean"))


# Without SQL: compared with sampled points and solved systems in tests.
@query("vo_10_triangle_meetings", None)
def _(t):
    p, o, d = corners(), point(3.3, 4.4, -1), point(0.01, 0.02, 1)
    box = (point(4, 5, 1), point(6.5, 9.5, 2.2))
    other = tuple(X.plus(x, point(0.35, 0.2, 0.1)) for x in (p[0], p[2], p[1]))
    made = {"line": X.line_triangle(o, d, p), "ray": X.ray_triangle(o, d, p), "segment": X.segment_triangle(o, X.plus(o, X.times(d, 2.5)), p)}
    return t("node_faces").select("fid", *(r4(v).alias(n) for n, v in made.items()), X.triangle_box(p, *box).alias("box"), X.triangle_triangle(p, other).alias("triangle"), X.sphere_triangle(point(5, 6, 2), F.lit(2.5), p).alias("sphere"))


@query("vo_12_box_meetings", None)
def _(t):
    box, o, d = G.around(center(), c("tight_radius")), point(-2, -3, 1), point(0.6, 0.8, 0.05)
    first, last = X.line_box(o, d, *box)
    return t("dag_nodes").select("node", r4(first).alias("first"), r4(last).alias("last"), r4(X.ray_box(o, d, *box)).alias("ray"), X.segment_box(o, X.plus(o, X.times(d, 20.0)), *box).alias("segment"))


@query("vo_25_edge_distances", None)
def _(t):
    """Of each face's first edge's line, first edge (segments) and whole triangle, from a line, a segment, a point and a triangle."""
    a, b, e = (2.0, 3.0, 6.0), (9.0, 12.0, 0.5), (4.0, 8.0, 7.0)
    names = ["lines", "segments", "point", "segment", "triangle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            p = tuple(tuple(rows.column(f"{x}{k}").to_numpy(zero_copy_only=False).astype(float) for x in "xyz") for k in range(3))
            with np.errstate(all="ignore"):
                made = [D.line_line(p[0], G.sub(p[1], p[0]), a, G.sub(b, a)), D.segment_segment(p[0], p[1], a, b), D.triangle_point(p, a), D.triangle_segment(p, a, b), D.triangle_triangle(p, (a, b, e))]
            yield pa.RecordBatch.from_arrays([rows.column("fid"), *(pa.array(v, from_pandas=True) for v in made)], names=["fid", *names])

    rows = t("node_faces").select("fid", *(f"{x}{k}" for k in range(3) for x in "xyz"))
    return rows.mapInArrow(run, "fid long, " + ", ".join(f"{n} double" for n in names)).select("fid", *(r4(c(n)).alias(n) for n in names))
