"""Approximate grouped quantiles from states that can be stored and merged.

A state counts positive values by logarithmic bucket: bucket i holds (g^(i-1), g^i] with
g = (1 + error) / (1 - error), so the bucket's middle value is within the relative error of every value
in it. States of parts of the data, or of later versions, add up; a group has no more rows than
its values span buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bucket of infinity, above all others.
_INFINITE = 1 << 40


def _growth(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the relative error lies between 0 and 1")
    return (1 + error) / (1 - error)


def sketch(df: DataFrame, value: str, groups: Sequence[str], error: float = 0.01) -> DataFrame:
    """(groups, bucket, n): the state of the positive values; others are left out."""
    v = F.col("_v")
    bucket = F.when(v == float("inf"), F.lit(_INFINITE)).otherwise(
        F.ceil(F.ln(v) / math.log(_growth(error)))
    )
    return (
        df.select(*groups, F.col(value).cast("double").alias("_v"))
        .where((v > 0) & ~F.isnan(v))
        .groupBy(*groups, bucket.cast("long").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(states: Sequence[DataFrame]) -> DataFrame:
    """One state of all; they must have the same groups and error."""
    every = reduce(DataFrame.unionByName, states)
    groups = [c for c in every.columns if c not in ("bucket", "n")]
    return every.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(
    state: DataFrame, quantiles: dict[str, float], error: float = 0.01
) -> DataFrame:
    """One row per group with a column per quantile: within the error of the least value that
    the share of values reaches."""
    groups = [c for c in state.columns if c not in ("bucket", "n")]
    by_group = Window.partitionBy(*groups)
    growth = _growth(error)
    middle = F.when(F.col("bucket") == _INFINITE, F.lit(float("inf"))).otherwise(
        2 * F.pow(F.lit(growth), F.col("bucket").cast("double")) / (growth + 1)
    )
    ranked = state.select(
        *groups,
        "bucket",
        middle.alias("_middle"),
        F.sum("n").over(by_group.orderBy("bucket")).alias("_upto"),
        F.sum("n").over(by_group).alias("_all"),
    )
    picked = [
        F.min_by("_middle", F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), F.col("bucket")))
        .alias(name)
        for name, q in quantiles.items()
    ]
    return ranked.groupBy(*groups).agg(*picked)
