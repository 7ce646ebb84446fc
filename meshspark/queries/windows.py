"""Order: running sums, previous rows, sampling, sorts, sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import points as P
from ..operators.prefix import running
from . import query

c = F.col
PAD = "(CAST((nface * 6 - 1) // 256 AS BIGINT) * 256 + 256)"


@query("win_01_budget", "SELECT node FROM (SELECT node, sum(nface) OVER (ORDER BY error DESC, node) AS s FROM dag_nodes) WHERE s <= 5000")
def _(t):
    from ..plans import cuts

    return cuts.by_budget(t("dag_nodes"), "nface", 5000)


@query("win_02_exclusive_prefix", "SELECT node, CAST(coalesce(sum(nvert) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM dag_nodes")
def _(t):
    return running(t("dag_nodes"), ["node"], {"s": "nvert"}).select("node", (c("s") - c("nvert")).alias("start"))


@query("win_03_patch_ends", "SELECT src, dst, CAST(sum(n) OVER (PARTITION BY src ORDER BY dst) AS BIGINT) AS tri_end FROM (SELECT src, dst, count(*) AS n FROM dag_patches GROUP BY src, dst)")
def _(t):
    n = t("dag_patches").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.select("src", "dst", F.sum("n").over(W.partitionBy("src").orderBy("dst")).alias("tri_end"))


@query("win_04_offsets", f"SELECT node, CAST(sum({PAD}) OVER (ORDER BY node) - {PAD} AS BIGINT) AS at FROM dag_nodes")
def _(t):
    from ..functions.geometry import pad

    d = t("dag_nodes").withColumn("padded", pad(c("nface") * 6))
    return running(d, ["node"], {"s": "padded"}).select("node", (c("s") - c("padded")).alias("at"))


@query("win_05_reverse", "SELECT (SELECT count(*) FROM dag_nodes) - 1 - node AS node, error FROM dag_nodes")
def _(t):
    n = t("dag_nodes").count()
    return t("dag_nodes").select((F.lit(n) - 1 - c("node")).alias("node"), "error")


@query("win_06_delta_codes", "SELECT node, pid, pid - lag(pid) OVER (PARTITION BY node ORDER BY pid) AS d FROM splats")
def _(t):
    return t("splats").select("node", "pid", (c("pid") - F.lag("pid").over(W.partitionBy("node").orderBy("pid"))).alias("d"))


@query("win_07_delta_values", "SELECT node, pid, x - lag(x, 1, 0) OVER (PARTITION BY node ORDER BY pid) AS d FROM splats")
def _(t):
    return t("splats").select("node", "pid", (c("x") - F.lag("x", 1, 0).over(W.partitionBy("node").orderBy("pid"))).alias("d"))


@query("win_08_stride_sample", "WITH n AS (SELECT vid, row_number() OVER (ORDER BY z, vid) - 1 AS i, count(*) OVER () AS total FROM mesh_vertices), k AS (SELECT DISTINCT CAST(floor(j * ((SELECT max(total) FROM n) / 300.0::DOUBLE)) AS BIGINT) AS place FROM range(300) r(j)) SELECT vid FROM n JOIN k ON k.place = n.i")
def _(t):
    v = t("mesh_vertices").select("vid", "z")
    return P.stride_sample(v, ["z", "vid"], 300, v.count()).select("vid")


@query("win_10_stream_order", "SELECT node, row_number() OVER (ORDER BY CASE WHEN node = 0 THEN 0 ELSE length(bin(node & -node)) - 1 END DESC, node) AS place FROM dag_nodes")
def _(t):
    from ..functions.bits import trailing_zeros

    d = t("dag_nodes").select("node", (-trailing_zeros(c("node"))).alias("l"))
    return running(d, ["l", "node"], number="place").select("node", "place")


@query("win_11_distinct_codes", "SELECT DISTINCT x, y, z FROM splats")
def _(t):
    return t("splats").select("x", "y", "z").distinct()


@query("srt_01_error_order", "SELECT node, row_number() OVER (ORDER BY error DESC, node) AS place FROM dag_nodes")
def _(t):
    return running(t("dag_nodes"), ["error", "node"], number="place", descending=True).select("node", "place")


@query("srt_04_vertex_order", "SELECT vid, row_number() OVER (ORDER BY z, y, x, vid) AS place FROM mesh_vertices")
def _(t):
    return running(t("mesh_vertices"), ["z", "y", "x", "vid"], number="place").select("vid", "place")


@query("srt_06_morton_order", "SELECT pid, row_number() OVER (ORDER BY " + " | ".join(f"(((CAST({v} AS BIGINT) >> {i}) & 1) << {3 * i + k})" for k, v in enumerate("xyz") for i in range(6)) + ", pid) AS place FROM splats")
def _(t):
    from ..functions.bits import morton

    code = morton(c("x"), c("y"), c("z"), 6)
    return running(t("splats").select("pid", code.alias("code")), ["code", "pid"], number="place").select("pid", "place")


@query("srt_09_top_k", "SELECT node, error FROM dag_nodes ORDER BY error DESC, node LIMIT 25")
def _(t):
    return t("dag_nodes").orderBy(F.desc("error"), "node").limit(25).select("node", "error")


@query("srt_09_bottom_k", "SELECT node, error FROM dag_nodes ORDER BY error, node LIMIT 25")
def _(t):
    return t("dag_nodes").orderBy("error", "node").limit(25).select("node", "error")


@query("srt_13_symbol_order", "SELECT r AS symbol, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, r) AS place FROM mesh_vertices GROUP BY r")
def _(t):
    n = t("mesh_vertices").groupBy(c("r").alias("symbol")).agg(F.count("*").alias("n"))
    return running(n, ["n", "symbol"], number="place", descending=True)


@query("agg_28_symbol_probabilities", "SELECT r AS symbol, CAST(count(*) * 255 // (SELECT count(*) FROM mesh_vertices) AS INT) AS p FROM mesh_vertices GROUP BY r")
def _(t):
    total = t("mesh_vertices").agg(F.count("*").alias("total"))
    n = t("mesh_vertices").groupBy(c("r").alias("symbol")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("symbol", (c("n") * 255 / c("total")).cast("int").alias("p"))  # total is one row


@query("agg_29_entropy", "SELECT round(-sum(p * log2(p)), 4) AS bits FROM (SELECT count(*) / (SELECT count(*) FROM mesh_vertices) AS p FROM mesh_vertices GROUP BY z)")
def _(t):
    n = t("mesh_vertices").groupBy("z").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("t"), F.sum(c("n") * F.log2("n")).alias("s")).select(F.round(F.log2("t") - c("s") / c("t"), 4).alias("bits"))


@query("set_01_union", "SELECT vid AS id FROM mesh_vertices UNION ALL SELECT node FROM dag_nodes")
def _(t):
    return t("mesh_vertices").select(c("vid").alias("id")).unionByName(t("dag_nodes").select(c("node").alias("id")))


@query("set_03_kept_and_deleted", "SELECT vid, vid % 3 = 0 AS kept FROM mesh_vertices")
def _(t):
    v = t("mesh_vertices").select("vid")
    kept = v.where("vid % 3 = 0")
    return kept.withColumn("kept", F.lit(True)).unionAll(v.join(kept, "vid", "left_anti").withColumn("kept", F.lit(False)))


@query("set_04_except", "SELECT node FROM dag_nodes WHERE error > 1 EXCEPT SELECT node FROM dag_nodes WHERE nface > 400")
def _(t):
    n = t("dag_nodes")
    return n.where("error > 1").select("node").join(n.where("nface > 400").select("node"), "node", "left_anti")


@query("set_05_append", "SELECT vid, z FROM mesh_vertices UNION ALL SELECT vid + (SELECT max(vid) + 1 FROM mesh_vertices), z FROM mesh_vertices")
def _(t):
    v = t("mesh_vertices").select("vid", "z")
    shift = v.agg(F.max("vid").alias("m")).first()["m"] + 1
    return v.unionAll(v.select((c("vid") + shift).alias("vid"), "z"))


@query("fn_b12_first_seen_numbers", "SELECT vid, r, dense_rank() OVER (ORDER BY f, r) - 1 AS n FROM (SELECT vid, r, min(vid) OVER (PARTITION BY r) AS f FROM mesh_vertices)")
def _(t):
    first = t("mesh_vertices").groupBy("r").agg(F.min("vid").alias("f"))
    numbered = running(first, ["f", "r"], number="n").select("r", (c("n") - 1).alias("n"))
    return t("mesh_vertices").join(numbered, "r").select("vid", "r", "n")
