"""Level-of-detail graphs: cuts, patches, checks, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans import cuts
from ..plans import dag as D
from . import query
from .scalars import _DIST, PLANES

c = F.col
CUT = "sel AS (SELECT node FROM (SELECT node, sum(size_bytes) OVER (ORDER BY error DESC, node) AS s FROM dag_nodes) WHERE s <= 200000)"
CLOSED = "RECURSIVE cut(node) AS (SELECT node FROM dag_nodes WHERE {0} AND node NOT IN (SELECT dst FROM dag_patches) UNION SELECT p.dst FROM cut JOIN dag_patches p ON p.src = cut.node JOIN dag_nodes n ON n.node = p.dst WHERE {1})"
chosen = lambda t: cuts.by_size(t("dag_nodes"), 200_000)
E2 = "error * error"


@query("cut_by_size", f"WITH {CUT} SELECT p.src, p.ordinal, p.dst FROM dag_patches p WHERE p.src IN (SELECT node FROM sel) AND p.dst NOT IN (SELECT node FROM sel)")
def _(t):
    return cuts.emitted_patches(t("dag_patches"), chosen(t))


@query("dag_06_select_by_size", f"WITH {CUT} SELECT node FROM sel")
def _(t):
    return chosen(t)


@query("dag_07_select_by_error", "SELECT node FROM dag_nodes WHERE error >= 2.5")
def _(t):
    return D.by_error(t("dag_nodes"), 2.5)


@query("dag_08_select_by_triangles", "SELECT node FROM (SELECT node, sum(nface) OVER (ORDER BY error DESC, node) AS s FROM dag_nodes) WHERE s <= 20000")
def _(t):
    return cuts.by_budget(t("dag_nodes"), "nface", 20_000)


@query("dag_01_traverse", "WITH " + CLOSED.format("nface > 120", "n.nface > 120") + " SELECT node FROM cut")
def _(t):
    return D.closed_cut(t("dag_nodes"), t("dag_patches"), c("nface") > 120)


@query("dag_09_view_cut", "WITH " + CLOSED.format("error / greatest(0.01 * sqrt(cx * cx + cy * cy + 1), 0.001) >= 20", "n.error / greatest(0.01 * sqrt(n.cx * n.cx + n.cy * n.cy + 1), 0.001) >= 20") + " SELECT node FROM cut")
def _(t):
    error = c("error") / F.greatest(0.01 * F.sqrt(c("cx") * c("cx") + c("cy") * c("cy") + 1), F.lit(0.001))
    return D.closed_cut(t("dag_nodes"), t("dag_patches"), error >= 20)


@query("dag_03_all_children", "SELECT p.src, p.dst, n.error FROM dag_patches p JOIN dag_nodes s ON s.node = p.src JOIN dag_nodes n ON n.node = p.dst")
def _(t):
    return D.children(t("dag_nodes"), t("dag_patches")).select("src", "dst", c("dst_error").alias("error"))


@query("dag_11_draw_list", f"WITH {CUT} SELECT p.src, count(*) AS patches FROM dag_patches p WHERE p.src IN (SELECT node FROM sel) AND p.dst NOT IN (SELECT node FROM sel) GROUP BY p.src")
def _(t):
    return cuts.emitted_patches(t("dag_patches"), chosen(t)).groupBy("src").agg(F.count("*").alias("patches"))


@query("dag_15_components", "SELECT vid AS id, vid % 20 AS comp FROM mesh_vertices WHERE (SELECT count(*) FROM mesh_vertices v WHERE v.vid % 20 = mesh_vertices.vid % 20) > 1")
def _(t):
    v = t("mesh_vertices")
    last = v.agg(F.max("vid").alias("m")).first()["m"]
    return D.components(v.where(c("vid") + 20 <= last).select(c("vid").alias("a"), (c("vid") + 20).alias("b")))


@query("dag_16_reverse", "SELECT (SELECT count(*) FROM dag_nodes) - 1 - src AS src, dst FROM dag_patches")
def _(t):
    n = t("dag_nodes").count()
    return t("dag_patches").select((F.lit(n) - 1 - c("src")).alias("src"), "dst")


@query("dag_18_vertex_budget", "SELECT node FROM (SELECT node, sum(nvert * 0.8::DOUBLE) OVER (ORDER BY error DESC, node) AS s FROM dag_nodes) WHERE s <= 10000.5")
def _(t):
    return cuts.by_budget(t("dag_nodes").withColumn("w", c("nvert") * 0.8), "w", 10_000.5)


@query("flt_09_drop_finest", "SELECT node FROM dag_nodes WHERE node NOT IN (SELECT src FROM dag_patches WHERE dst = (SELECT count(*) FROM dag_nodes))")
def _(t):
    n = t("dag_nodes")
    return D.drop_finest(n, t("dag_patches"), n.count()).select("node")


@query("agg_24_last_level_size", "SELECT CAST(sum(size_bytes) AS BIGINT) AS bytes FROM dag_nodes WHERE node IN (SELECT src FROM dag_patches WHERE dst = (SELECT count(*) FROM dag_nodes))")
def _(t):
    n = t("dag_nodes")
    return D.finest_level(n, t("dag_patches"), n.count()).agg(F.sum("size_bytes").alias("bytes"))


@query("flt_10_exposed", f"WITH {CUT} SELECT DISTINCT p.src AS node FROM dag_patches p WHERE p.src IN (SELECT node FROM sel) AND p.dst NOT IN (SELECT node FROM sel)")
def _(t):
    return D.exposed(t("dag_patches"), chosen(t))


@query("flt_11_outside_planes", f"SELECT node FROM dag_nodes WHERE {' OR '.join(d + ' < 0' for d in _DIST)}")
def _(t):
    return t("dag_nodes").where(G.outside_planes((c("cx"), c("cy"), c("cz")), c("tight_radius"), PLANES)).select("node")


@query("flt_15_patch_draw", f"WITH {CUT} SELECT src, dst FROM dag_patches WHERE dst NOT IN (SELECT node FROM sel)")
def _(t):
    return t("dag_patches").join(chosen(t).withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")


@query("jon_02_edge_lookup", "SELECT p.src, a.error AS e0, p.dst, b.error AS e1 FROM dag_patches p JOIN dag_nodes a ON a.node = p.src JOIN dag_nodes b ON b.node = p.dst")
def _(t):
    return D.children(t("dag_nodes"), t("dag_patches")).select("src", c("src_error").alias("e0"), "dst", c("dst_error").alias("e1"))


@query("jon_06_remap", f"WITH {CUT} SELECT p.src, p.ordinal, coalesce(s.node, -1) AS dst FROM dag_patches p JOIN sel a ON a.node = p.src LEFT JOIN sel s ON s.node = p.dst")
def _(t):
    return D.remap(t("dag_patches"), chosen(t).withColumn("new", c("node")), -1)


@query("snk_02_extract", f"WITH {CUT}, m AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS new FROM sel) SELECT a.new AS src, p.ordinal, coalesce(b.new, (SELECT count(*) FROM m)) AS dst FROM dag_patches p JOIN m a ON a.node = p.src LEFT JOIN m b ON b.node = p.dst")
def _(t):
    from ..operators.prefix import running

    sel = chosen(t)
    numbered = running(sel, ["node"], number="n").select("node", (c("n") - 1).alias("new"))
    return D.remap(t("dag_patches"), numbered, sel.count())


@query("agg_26_saturate", "SELECT n.node, round(greatest(n.error, coalesce(max(k.error) * 1.01, n.error)), 6) AS error FROM dag_nodes n LEFT JOIN dag_patches p ON p.src = n.node LEFT JOIN dag_nodes k ON k.node = p.dst GROUP BY n.node, n.error")
def _(t):
    return D.saturate_once(t("dag_nodes"), t("dag_patches")).select("node", F.round("error", 6).alias("error"))


@query("agg_18_mean_error", f"SELECT round(avg(sqrt({E2})), 6) AS e FROM dag_nodes")
def _(t):
    return t("dag_nodes").agg(F.round(F.avg(F.sqrt(c("error") * c("error"))), 6).alias("e"))


@query("agg_19_quadratic_error", f"SELECT round(sqrt(avg({E2})), 6) AS e FROM dag_nodes")
def _(t):
    return t("dag_nodes").agg(F.round(F.sqrt(F.avg(c("error") * c("error"))), 6).alias("e"))


@query("agg_20_logarithmic_error", f"SELECT round(exp(avg(ln({E2})) / 2), 6) AS e FROM dag_nodes")
def _(t):
    return t("dag_nodes").agg(F.round(F.exp(F.avg(F.log(c("error") * c("error"))) / 2), 6).alias("e"))


@query("agg_21_least_error", "SELECT min(error) AS e FROM dag_nodes WHERE error > 0")
def _(t):
    return t("dag_nodes").agg(F.min(F.when(c("error") > 0, c("error"))).alias("e"))


@query("agg_23_faces_per_node", "SELECT round(avg(nface), 4) AS mean, round(stddev_pop(nface), 4) AS deviation FROM dag_nodes")
def _(t):
    return t("dag_nodes").agg(F.round(F.avg("nface"), 4).alias("mean"), F.round(F.stddev_pop("nface"), 4).alias("deviation"))


@query("fn_s08_patch_report", "SELECT src, string_agg('[' || CAST(dst AS VARCHAR) || ']', ' ' ORDER BY dst) AS patches FROM dag_patches GROUP BY src")
def _(t):
    ends = F.array_sort(F.collect_list("dst"))
    return t("dag_patches").groupBy("src").agg(F.concat_ws(" ", F.transform(ends, lambda d: F.format_string("[%d]", d))).alias("patches"))
