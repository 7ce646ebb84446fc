"""The priority cache as batch queries over requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiers as T
from . import query

LAST = "last AS (SELECT node, p.frame AS frame, p.error AS error, 1000 + node % 7 * 100 AS size FROM (SELECT node, max({'frame': frame, 'error': error}) AS p FROM tokens GROUP BY node))"
ORDER = "ORDER BY frame DESC, error DESC, node"
sized = lambda t: T.latest(t("tokens")).withColumn("size", 1000 + F.col("node") % 7 * 100)


@query("str_06_add_once", "SELECT DISTINCT node FROM tokens")
def _(t):
    return t("tokens").select("node").distinct()


@query("str_07_latest_priority", f"WITH {LAST} SELECT node, strftime(frame, '%Y-%m-%d %H:%M:%S') AS frame, error FROM last")
def _(t):
    return T.latest(t("tokens")).withColumn("frame", F.date_format("frame", "yyyy-MM-dd HH:mm:ss"))


@query("srt_08_priority_order", f"WITH {LAST} SELECT node, row_number() OVER ({ORDER}) AS place FROM last")
def _(t):
    return T.ranked(T.latest(t("tokens"))).select("node", "place")


@query("str_08_resident", f"WITH {LAST} SELECT node, held FROM (SELECT node, CAST(sum(size) OVER ({ORDER}) AS BIGINT) AS held FROM last) WHERE held <= 30000")
def _(t):
    return T.resident(sized(t), 30_000).select("node", "held")


@query("str_09_evicted", f"WITH {LAST} SELECT node FROM (SELECT node, sum(size) OVER ({ORDER}) AS held FROM last) WHERE held > 30000 AND node % 10 <> 0")
def _(t):
    s = sized(t)
    return T.evicted(s, 30_000, s.where("node % 10 = 0").select("node"))


@query("str_12_token_cap", f"WITH {LAST} SELECT node FROM (SELECT node, row_number() OVER ({ORDER}) AS place FROM last) WHERE place <= 40")
def _(t):
    return T.ranked(T.latest(t("tokens"))).where("place <= 40").select("node")


@query("str_11_flush", "SELECT event_id FROM tokens WHERE event_type <> 'click'")
def _(t):
    return t("tokens").where("event_type <> 'click'").select("event_id")


@query("flt_18_token_model", "SELECT event_id, node FROM tokens WHERE node % 4 = 1")
def _(t):
    return t("tokens").where("node % 4 = 1").select("event_id", "node")


@query("agg_39_frame_counters", "SELECT strftime(frame, '%Y-%m-%d %H:%M:%S') AS frame, count(*) AS requests, CAST(sum(CASE WHEN error > 50 THEN 1 ELSE 0 END) AS BIGINT) AS coarse FROM tokens GROUP BY frame")
def _(t):
    return t("tokens").groupBy(F.date_format("frame", "yyyy-MM-dd HH:mm:ss").alias("frame")).agg(F.count("*").alias("requests"), F.sum(F.when(F.col("error") > 50, 1).otherwise(0)).alias("coarse"))
