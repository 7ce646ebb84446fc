"""Running sums against plain ones; few different first values don't gather rows in one range."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meshspark.operators.prefix import running


@pytest.mark.parametrize("descending", [False, True])
def test_ranges_are_cut_on_the_whole_order(spark, descending):
    rows = [([None, 1.5, float("nan"), 2.5][min(i % 40, 3)], f"k{i % 7}" if i % 11 else None, i, i % 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "x double, k string, i long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = running(df, ["x", "k", "i"], {"s": "v"}, number="n", descending=descending).withColumn("p", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = F.desc("x") if descending else F.asc("x")
    want, total = [], 0
    for n, r in enumerate(df.orderBy(first, "k", "i").collect(), 1):
        total += r["v"]
        want.append((r["i"], total, n))
    assert sorted((r["i"], r["s"], r["n"]) for r in got) == sorted(want)
    assert max(sum(r["p"] == p for r in got) for p in range(8)) < 2400


def test_no_rows(spark):
    assert running(spark.createDataFrame([], "x double, i long"), ["x", "i"], number="n").count() == 0
