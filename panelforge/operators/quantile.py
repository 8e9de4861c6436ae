"""Exact grouped quantiles of positive numbers without gathering a group in one task.

Rows are counted per group and value first (map-side combined), so only counts are shuffled.
The values of a group are cut into slices of nearly equal ratio. A running sum over the slices
tells which slice holds a wanted rank, and a running sum inside each slice which value: no
window is longer than a group's slices or a slice's different values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.operators.joins import null_safe_join

_INFINITE = float("inf")
#: Slices per doubling of the value, and the slice of infinity, above all others.
_SLICES = 1024
_LAST_SLICE = 1 << 31


def positive_quantiles(
    df: DataFrame, value: str, groups: Sequence[str], quantiles: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles of the positive values per group, one column each.

    Infinity is a value like any other; missing values, NaN and values up to zero are left out.
    """
    groups = list(groups)
    v = F.col("_v")
    # the logarithm never falls as the value rises, so slices are in the order of values
    part = F.when(v == _INFINITE, F.lit(_LAST_SLICE)).otherwise(F.floor(F.log2(v) * _SLICES))
    counts = (
        df.select(*groups, F.col(value).cast("double").alias("_v"))
        .where((v > 0.0) & ~F.isnan(v))
        .select(*groups, part.cast("long").alias("_slice"), "_v")
        .groupBy(*groups, "_slice", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    slices = (
        counts.groupBy(*groups, "_slice")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_end", F.sum("_n").over(_running(groups, "_slice")))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups)))
        .withColumn("_request", F.explode(_requests(F.col("_total"), quantiles)))
        .select(*groups, "_slice", "_n", "_end", "_request.*")
    )
    start = F.col("_end") - F.col("_n")
    wanted = slices.where((F.col("_rank") >= start) & (F.col("_rank") < F.col("_end"))).select(
        *groups, "_slice", "_id", "_share", (F.col("_rank") - start).alias("_rank")
    )
    inside = counts.withColumn("_upto", F.sum("_n").over(_running([*groups, "_slice"], "_v")))
    picked = null_safe_join(inside, wanted, [*groups, "_slice"], "inner").where(
        (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    )
    columns = []
    for i, name in enumerate(quantiles):
        low = F.max(F.when(F.col("_id") == 2 * i, v))
        high = F.max(F.when(F.col("_id") == 2 * i + 1, v))
        share = F.max(F.when(F.col("_id") == 2 * i, F.col("_share")))
        between = F.when((high == low) | (share == 0.0), low).otherwise(low + (high - low) * share)
        columns.append(between.alias(name))
    return picked.groupBy(*groups).agg(*columns)


def _running(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _requests(total: Column, quantiles: dict[str, float]) -> Column:
    """Zero-based ranks of the two neighbours of every quantile."""
    entries = []
    for i, q in enumerate(quantiles.values()):
        place = (total - 1).cast("double") * F.lit(q)
        for side, rank in ((0, F.floor(place)), (1, F.ceil(place))):
            entries.append(
                F.struct(
                    F.lit(2 * i + side).alias("_id"),
                    (place - F.floor(place)).alias("_share"),
                    rank.cast("long").alias("_rank"),
                )
            )
    return F.array(*entries)
