"""Column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import colour as C
from ..functions import geometry as G
from . import register_scalar

big = lambda e: f"CAST({e} AS BIGINT)"
PLANES = [(1.0, 0.0, 0.0, -2.0), (-1.0, 0.0, 0.0, 15.0), (0.0, 1.0, 0.0, -3.0), (0.0, -1.0, 0.0, 40.0)]
_DIST = [f"(cx * {a} + cy * {b} + cz * {d} + {e} + tight_radius)" for a, b, d, e in PLANES]


class _Any:
    """Stands for columns and for the modules that make them while only names and SQL are wanted (no session)."""

    def __getattr__(self, name):
        return self

    def __call__(self, *args, **kwargs):
        return self

    def __iter__(self):
        return iter((self,) * 3)

    def __getitem__(self, key):
        return self

    def _op(self, *other):
        return self

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __rtruediv__ = __mod__ = __rmod__ = __and__ = __or__ = __invert__ = __neg__ = __eq__ = __ne__ = __lt__ = __le__ = __gt__ = __ge__ = _op
    __hash__ = object.__hash__


def _morton_sql(x: str, y: str, z: str, levels: int) -> str:
    return big(" | ".join(f"(((CAST({v} AS BIGINT) >> {i}) & 1) << {3 * i + k})" for k, v in enumerate((x, y, z)) for i in range(levels)))


def define(F, G, B, C, scalar):
    c = F.col
    P = G.vec()
    CELL = {a: c(a).cast("long") for a in "xyz"}


    M = B.morton(CELL["x"], CELL["y"], CELL["z"], 6)
    M_SQL = _morton_sql("x", "y", "z", 6)
    scalar("fn_m01_dot_cross_norm", "mesh_vertices", "vid", {"dot": (F.round(G.dot(P, (F.lit(1.0), F.lit(2.0), F.lit(3.0))), 6), "round(x * 1 + y * 2 + z * 3, 6)"), "norm": (F.round(G.norm(P), 6), "round(sqrt(x * x + y * y + z * z), 6)"), "cx": (F.round(G.cross(P, (F.lit(1.0), F.lit(2.0), F.lit(3.0)))[0], 6), "round(y * 3 - z * 2, 6)")})
    scalar("fn_m02_point_helpers", "mesh_vertices", "vid", {"sx": (c("x") + 1, "x + 1"), "sy": (c("y") * 2, "y * 2"), "sz": (c("z") / 4, "z / 4")})
    scalar("fn_m03_snap", "splats", "pid", {"v": (G.snap(c("x") - 25, 4.0), "4.0 * CAST(trunc((x - 25) / 4.0) AS INT)")})
    scalar("fn_m04_grid_quantise", "splats", "pid", {"v": (G.grid(c("x") - 25, 2), big("floor((x - 25) / 4.0 + 0.5)"))})
    scalar("fn_m05_dequantise", "splats", "pid", {"v": ((G.grid(c("x"), 2) + 3) * F.lit(4.0), "(floor(x / 4.0 + 0.5) + 3) * 4.0")})
    scalar("fn_m06_ilog2", "dag_nodes", "node", {"v": (B.ilog2(c("node")), "CASE WHEN node = 0 THEN 0 ELSE CAST(floor(log2(node)) AS INT) END")})
    scalar("fn_m07_needed_bits", "dag_nodes", "node", {"v": (B.needed_bits(c("node") - 700), "CAST(CASE WHEN node - 700 IN (0, -1) THEN 1 WHEN node > 700 THEN length(bin(node - 700)) + 1 ELSE length(bin(699 - node)) + 1 END AS INT)")})
    CENTER = (c("cx"), c("cy"), c("cz"))
    scalar("fn_m10_planes_distance", "dag_nodes", "node", {"v": (F.round(G.planes_distance(CENTER, c("tight_radius"), PLANES), 4), f"round(least({', '.join(_DIST)}), 4)")})
    _DD = "(cx * cx + cy * cy + cz * cz)"
    scalar("fn_m13_ray_sphere", "dag_nodes", "node", {"v": (F.round(G.ray_sphere(CENTER, c("tight_radius") * 3, (0, 0, 0), (0.6, 0.8, 0.0)), 4), f"round(CASE WHEN {_DD} <= 9 * tight_radius * tight_radius THEN 0 WHEN cx * 0.6 + cy * 0.8 > 0 AND {_DD} - (cx * 0.6 + cy * 0.8) * (cx * 0.6 + cy * 0.8) <= 9 * tight_radius * tight_radius THEN (cx * 0.6 + cy * 0.8) - sqrt(greatest(9 * tight_radius * tight_radius - ({_DD} - (cx * 0.6 + cy * 0.8) * (cx * 0.6 + cy * 0.8)), 0)) END, 4)")})
    scalar("fn_m16_normal_pack", "splats", "pid", {"v": ((c("y") / 16 * 32766).cast("int"), "CAST(trunc(y / 16 * 32766) AS INT)")})
    scalar("fn_m18_clamp_split", "dag_nodes", "node", {"v": (F.round(G.clamp_split(c("cx"), F.lit(0.0), c("cx") + c("cy"), 0.333), 4), "round(least(greatest(cx, (cx + cy) * ((1 - 0.333::DOUBLE) / 2)), (cx + cy) * ((1 + 0.333::DOUBLE) / 2)), 4)")})
    scalar("fn_m19_longest_axis", "mesh_vertices", "vid", {"axis": (G.longest_axis(c("x"), c("y"), c("z")), "CASE WHEN x > y AND x > z THEN 0 WHEN NOT (x > y) AND y > z THEN 1 ELSE 2 END")})
    scalar("fn_m23_zigzag", "dag_nodes", "node", {"u": (B.zigzag(c("node") - 500), "CASE WHEN node < 500 THEN -2 * (node - 500) - 1 ELSE 2 * (node - 500) END"), "back": (B.unzigzag(B.zigzag(c("node") - 500)), "node - 500")})
    scalar("fn_m24_round_up_pow2", "dag_nodes", "node", {"v": (B.round_up_pow2(c("node")), big("CASE WHEN node <= 1 THEN 1 ELSE power(2, length(bin(node - 1))) END"))})
    scalar("fn_b01_morton", "splats", "pid", {"code": (M, M_SQL)})
    UNIT = {a: F.floor(c(a) / 51 * 64) for a in "xyz"}
    scalar("fn_b02_morton_in_box", "splats", "pid", {"code": (B.morton(UNIT["x"], UNIT["y"], UNIT["z"], 6), _morton_sql("floor(x / 51 * 64)", "floor(y / 51 * 64)", "floor(z / 51 * 64)", 6))})
    scalar("fn_b05_highest_difference", "dag_nodes", "node", {"v": (B.highest_difference(c("node"), c("node") + 5), "CAST(length(bin(xor(node, node + 5))) - 1 AS INT)")})
    scalar("fn_b06_bit_ops", "dag_nodes", "node", {"s": (B.set_bit(c("node"), 3), big("node | 8")), "cl": (B.clear_bit(c("node"), 1), big("node & ~2")), "t": (B.test_bit(c("node"), 2), "(node & 4) <> 0")})
    scalar("fn_b09_flags", "dag_nodes", "node", {"textured": (c("node").bitwiseAND(F.lit(1)) != 0, "(node & 1) <> 0"), "packed": (c("node").bitwiseAND(F.lit(6)) != 0, "(node & 6) <> 0")})
    scalar("fn_s05_range_header", "dag_nodes", "node", {"h": (F.format_string("bytes=%d-%d", c("node") * 256, c("node") * 256 + c("size_bytes") - 1), "'bytes=' || CAST(node * 256 AS VARCHAR) || '-' || CAST(node * 256 + size_bytes - 1 AS VARCHAR)")})
    scalar("fn_s03_suffix", "part", "p_partkey", {"is_plate": (c("p_type").endswith("STEEL"), "suffix(p_type, 'STEEL')"), "file": (F.concat(F.regexp_replace("p_name", r"\s.*$", ""), F.lit(".ply")), "regexp_replace(p_name, '\\s.*$', '') || '.ply'")})
    scalar("fn_s02_line_tokens", "mesh_faces", "fid", {"a": (F.split(F.split(F.concat_ws(" ", F.lit("f"), F.concat(c("v0") + 1, F.lit("/7/9")), c("v1") + 1), " ")[1], "/")[0].cast("long") - 1, "v0")})
    scalar("prj_13_affine", "mesh_vertices", "vid", {n: (F.round(v, 6), f"round({e}, 6)") for n, v, e in zip(("tx", "ty", "tz"), G.affine(P, [2, 0, 0, 1, 0, 3, 0, -1, 0, 0, 0.5, 4, 0, 0, 0, 1]), ("2 * x + 1", "3 * y - 1", "0.5 * z + 4"), strict=True)})
    scalar("snk_09_pad", "dag_nodes", "node", {"padded": (G.pad(c("nface") * 6 + 1), big("(((nface * 6 + 1) - 1) // 256) * 256 + 256"))})
    scalar("flt_20_tiny_normal", "splats", "pid", {"nx": (F.when(G.norm(P) < 5, F.lit(1.0)).otherwise(c("x")), "CASE WHEN sqrt(x * x + y * y + z * z) < 5 THEN 1.0 ELSE x END")})
    RGB = (c("r"), c("g"), c("b"))
    scalar("fn_c01_to_ycc", "mesh_vertices", "vid", {n: (v, e) for n, v, e in zip(("y0", "cb", "cr"), C.to_ycc(*RGB), ("g", "((b - g) % 256 + 256) % 256", "((r - g) % 256 + 256) % 256"), strict=True)})
    scalar("fn_c02_round_trip", "mesh_vertices", "vid", {n: (v, n[0]) for n, v in zip(("r1", "g1", "b1"), C.from_ycc(*C.to_ycc(*RGB)), strict=True)})
    scalar("fn_c03_quantise", "mesh_vertices", "vid", {"q": (C.quantise(c("r"), 8), "(r // 8) * 8")})
    scalar("fn_c04_ramp", "mesh_vertices", "vid", {"g0": (C.ramp(c("z"), 0.0, 8.0)[1], "CAST(floor(CASE WHEN least(z / 8, 1.0) * 4 < 1 THEN 255 * (least(z / 8, 1.0) * 4) WHEN least(z / 8, 1.0) * 4 < 3 THEN 255.0 ELSE 255 * (1 - (least(z / 8, 1.0) * 4 - 3)) END) AS INT)")})
    scalar("fn_c08_gray_lerp", "mesh_vertices", "vid", {"gray": (C.gray(c("z") / 8), "CAST(floor(least(z / 8, 1.0) * 255) AS INT)"), "mid": (C.lerp(c("r"), c("g"), F.lit(0.25)), "r * 0.75::DOUBLE + g * 0.25::DOUBLE")})
    scalar("win_09_ruler_level", "dag_nodes", "node", {"level": (B.trailing_zeros(c("node")), "CAST(CASE WHEN node = 0 THEN 0 ELSE length(bin(node & -node)) - 1 END AS INT)")})
    scalar("msh_09_alternate_split", "dag_nodes", "node", {"ratio": (F.when(B.ilog2(c("node") + 1) % 2 == 1, F.lit(0.3333)).otherwise(F.lit(0.6666)), "CAST(CASE WHEN (length(bin(node + 1)) - 1) % 2 = 1 THEN 0.3333 ELSE 0.6666 END AS DOUBLE)")})
    scalar("msh_19_texture_size", "dag_nodes", "node", {"w": (F.greatest(F.lit(1).cast("long"), F.floor(c("nvert") / F.sqrt(F.lit(2.0)))), big("greatest(1, floor(nvert / sqrt(2.0::DOUBLE)))"))})
    scalar("fn_b11_gather", "mesh_faces", "fid", {"second": (F.element_at(F.transform(F.array(F.lit(2), F.lit(0), F.lit(1)), lambda i: F.get(F.array("v0", "v1", "v2"), i)), 1), "v2"), "last": (F.element_at(F.reverse(F.array("v0", "v1", "v2")), 1), "v2")})


def _columns(name: str) -> dict:
    found = {}
    define(F, G, B, C, lambda n, table, key, made, where=None: found.update({n: made}))
    return found[name]


define(*(_Any() for _ in range(4)), lambda *args, **kwargs: register_scalar(_columns, *args, **kwargs))
