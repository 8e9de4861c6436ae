"""Join helpers. No side is hinted for broadcast here: Spark picks it from measured sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join where missing keys equal each other; right-hand keys are not repeated."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def star_join(driver: DataFrame, dimensions: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join several tables to a driver; a column already present is not taken again."""
    result = driver
    for dimension in dimensions:
        fresh = [c for c in dimension.columns if c == key or c not in result.columns]
        result = result.join(dimension.select(*fresh), key, "left")
    return result


def rows_not_listed(
    candidates: DataFrame, listed: DataFrame, unit: str, time: str
) -> DataFrame:
    """Rows whose (unit, time) pair is NOT IN the listed pairs, with SQL's three-valued logic.

    A missing unit or time makes the comparison unknown, and unknown excludes the row.
    """
    pairs = listed.select(F.col(unit).alias("_u"), F.col(time).alias("_t")).distinct()
    same_unit = F.col(unit) == F.col("_u")
    time_may_match = (
        (F.col(time) == F.col("_t")) | F.col(time).isNull() | F.col("_t").isNull()
    )
    known = candidates.where(F.col(unit).isNotNull()).join(
        pairs.where(F.col("_u").isNotNull()), same_unit & time_may_match, "left_anti"
    )
    nameless = pairs.where(F.col("_u").isNull())
    known = _drop_where_time_may_match(known, nameless, time)
    # A candidate without a unit is excluded by any listed pair whose time may match.
    unknown = _drop_where_time_may_match(candidates.where(F.col(unit).isNull()), pairs, time)
    return known.unionByName(unknown)


def _drop_where_time_may_match(df: DataFrame, pairs: DataFrame, time: str) -> DataFrame:
    counts = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_t").isNull()).alias("n_timeless")
    )
    times = pairs.select("_t").where(F.col("_t").isNotNull()).distinct()
    kept = df.join(times, F.col(time) == F.col("_t"), "left_anti")
    any_pair = counts.select("n").scalar() > 0
    any_timeless = counts.select("n_timeless").scalar() > 0
    return kept.where(~any_timeless & ~(F.col(time).isNull() & any_pair))


def union_distinct_by_name(*frames: DataFrame) -> DataFrame:
    """Union by column name, absent columns null, duplicate rows removed."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result.distinct()


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """Columns to rows; missing values give no row."""
    long = df.unpivot(list(ids), list(values), name, value)
    return long.where(F.col(value).isNotNull())
