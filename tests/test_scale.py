"""What the plans move and hold when one key has a third of all rows."""

import re

from pyspark.sql import functions as F

from panelforge.linkage.blocking import tiled_join
from panelforge.operators import anomaly, panel, quantile
from panelforge.plans.derived import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=3000):
    """Unit 0 holds a third of all rows, many of them in the same year."""
    unit = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1)
    return spark.range(n).select(
        unit.cast("long").alias("unit"),
        (2000 + F.col("id") % 7).alias("year"),
        (F.col("id") + 1).cast("double").alias("v"),
        F.concat(F.lit("text "), F.col("id")).alias("note"),
    )


def test_balance_does_not_shuffle_rows(spark):
    text = plan(panel.balance(hot(spark), "year", ["unit"]))
    rows_branch = text.split("Union")[1].split("Generate")[0]
    assert "Exchange" not in rows_branch
    # The branch that is shuffled carries keys and their sets of periods only.
    assert "note" not in text.split("Generate explode")[1]


def test_hot_unit_keeps_all_rows(spark):
    data = hot(spark)
    balanced = panel.balance(data, "year", ["unit"])
    assert balanced.where("v IS NOT NULL").count() == data.count()
    filled = panel.fill_missing(data, {"v": F.when(F.col("v") > 9, F.col("v"))}, ["unit"], "year")
    assert filled.count() == data.count()
    kept = anomaly.drop_ambiguous(data, "v", ["unit", "year"])
    assert kept.where("unit = 0").count() == 0


def lines_below_exchanges(text):
    """For each exchange of a plan, the operators below it down to the next exchange or scan."""
    lines = [re.sub(r"^[\s:+*\-()\d]*", "", line) for line in text.splitlines()]
    for k, line in enumerate(lines):
        if line.startswith("Exchange hashpartitioning"):
            below = []
            for other in lines[k + 1 :]:
                below.append(other)
                if re.match(r"Exchange|Scan|FileScan|Range|LocalTableScan", other):
                    break
            yield line, below


def test_quantile_shuffles_counts_only(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        result = quantile.positive_quantiles(hot(spark), "v", ["unit"], {"q": 0.9})
        found = list(lines_below_exchanges(plan(result)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found
    # no exchange stands on a scan: between them there is always an aggregate of counts
    for _, below in found:
        assert below[-1].startswith("Exchange") or any("HashAggregate" in b for b in below)
    got = {r.unit: r.q for r in result.collect()}
    expected = hot(spark).groupBy("unit").agg(F.percentile("v", F.lit(0.9)).alias("q")).collect()
    for r in expected:
        assert abs(got[r.unit] - r.q) < 1e-6


def test_quantile_keeps_infinity(spark):
    inf = float("inf")
    rows = [(1, 1.0), (1, 2.0), (1, inf), (2, inf), (2, inf), (3, float("nan")), (3, 4.0), (3, -1.0)]
    data = spark.createDataFrame(rows, "g int, v double")
    got = quantile.positive_quantiles(data, "v", ["g"], {"q": 0.5}).collect()
    assert {r.g: r.q for r in got} == {1: 2.0, 2: inf, 3: 4.0}


def test_no_tile_exceeds_its_share_of_a_hot_block(spark):
    data = hot(spark).withColumn("id", F.monotonically_increasing_id()).select("id", "unit")
    pairs = tiled_join(data.where("id % 2 = 0"), data.where("id % 2 = 1"), ["unit"], "id", 100)
    # the stored list of hot blocks is broadcast, so records are exchanged by tile only
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(pairs))
    assert all("_tile" in k for k in keys)
    left = data.where("unit = 0 AND id % 2 = 0").count()
    right = data.where("unit = 0 AND id % 2 = 1").count()
    assert pairs.where("unit_l = 0").count() == left * right


def test_scans_are_pruned_and_filters_pushed(spark):
    lineitem = table(spark, "/root/testdata/sf0.001", "lineitem")
    query = (
        lineitem.where((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 10))
        .groupBy("l_suppkey")
        .agg(F.sum("l_quantity"))
    )
    text = plan(query)
    assert "PushedFilters: [IsNotNull(l_returnflag), IsNotNull(l_quantity)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_suppkey", "l_quantity", "l_returnflag",
    }
