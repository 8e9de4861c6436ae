"""Detection of unit errors and outliers in annual series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.constants import RANGE_TOLERANCE, UNIT_ERROR_LOG10
from panelforge.functions.series import (
    by_time,
    log_change,
    magnitude,
    median,
    over_unit,
    shift_magnitude,
)
from panelforge.operators.joins import null_safe_join
from panelforge.operators.quantile import positive_quantiles


def flag_jumps(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    time: str,
    threshold_delta: float = UNIT_ERROR_LOG10,
    threshold_range: float = RANGE_TOLERANCE,
    scalar: str = "scalar",
    flag: str = "is_jump",
) -> DataFrame:
    """Mark spikes of about a power of ten that revert in the unit's next row.

    Adds ``scalar`` (the power of ten of the change) and ``flag``. All window columns share
    one partitioning, so the whole check is a single shuffle and sort.
    """
    v, unit, ordered = F.col(value), over_unit(keys), by_time(keys, time)
    staged = df.withColumns(
        {
            "_min": F.min(v).over(unit),
            "_max": F.max(v).over(unit),
            "_into": log_change(v, F.lag(v).over(ordered)),
            "_out": log_change(F.lead(v).over(ordered), v),
        }
    ).withColumn(scalar, magnitude(F.col("_into")))
    within = shift_magnitude(v, F.col(scalar)).between(
        F.col("_min") * (1 - threshold_range), F.col("_max") * (1 + threshold_range)
    )
    fired = (
        F.col(scalar).isNotNull()
        & F.coalesce(F.abs("_into") > threshold_delta, F.lit(False))
        & F.coalesce(F.abs("_out") > threshold_delta, F.lit(False))
        & (F.signum("_into") != F.signum("_out"))
        & within
    )
    return staged.withColumn(flag, F.coalesce(fired, F.lit(False))).drop(
        "_min", "_max", "_into", "_out"
    )


def repair_units(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    time: str,
    threshold_delta: float = UNIT_ERROR_LOG10,
    threshold_range: float = RANGE_TOLERANCE,
) -> DataFrame:
    """Divide flagged spikes by their power of ten; row count and columns stay as they are."""
    flagged = flag_jumps(
        df, value, keys, time, threshold_delta, threshold_range, "_scalar", "_is_jump"
    )
    repaired = F.when(
        F.col("_is_jump"), shift_magnitude(F.col(value), F.col("_scalar"))
    ).otherwise(F.col(value))
    return flagged.withColumn(value, repaired).drop("_scalar", "_is_jump")


def _local_median(column: Column, keys: Sequence[str], time: str, before: int, after: int) -> Column:
    return median(column).over(by_time(keys, time).rowsBetween(before, after))


def quantile_band(
    df: DataFrame, reference: str, groups: Sequence[str], time: str, threshold_quantile: float
) -> DataFrame:
    """Exact upper and lower quantile of the positive reference per group and period."""
    return positive_quantiles(
        df,
        reference,
        [*groups, time],
        {"_quantile_upper": threshold_quantile, "_quantile_lower": 1 - threshold_quantile},
    )


def flag_outliers(
    df: DataFrame,
    reference: str,
    target: str,
    identifiers: Sequence[str],
    groups: Sequence[str],
    time: str,
    threshold_quantile: float = 0.99,
    threshold_outlier: float = 2.0,
) -> DataFrame:
    """Mark target values far from the unit's median whose reference is odd as well.

    The reference is odd when it is far from the unit's median, or outside the quantile
    band of its group and period. Medians come from up to four earlier in-band rows, else
    from the whole unit. Helper columns stay in the output.
    """
    keys = [*identifiers, *groups]
    unit = over_unit(keys)
    band = quantile_band(df, reference, groups, time, threshold_quantile)
    banded = null_safe_join(df, band, [*groups, time], "left").withColumn(
        "is_in_range", F.col(reference).between(F.col("_quantile_lower"), F.col("_quantile_upper"))
    )
    medians = {}
    for c in (reference, target):
        in_band = F.when(F.col("is_in_range"), F.col(c))
        medians[f"{c}_median_global"] = median(F.col(c)).over(unit)
        medians[f"{c}_median_local"] = _local_median(in_band, keys, time, -4, -1)
    staged = banded.withColumns(medians).withColumns(
        {
            f"{c}_median": F.coalesce(f"{c}_median_local", f"{c}_median_global")
            for c in (reference, target)
        }
    )
    floor = F.lit(0.1 / threshold_outlier)
    far = F.log10(F.lit(threshold_outlier))
    distances = {}
    for c in (reference, target):
        usable = F.col(c).isNotNull() & (F.col(f"{c}_median") > 0.0)
        relative = F.greatest(F.try_divide(F.col(c), F.col(f"{c}_median")), floor)
        distances[f"{c}_to_median"] = F.when(usable, F.log10(relative))
    return (
        staged.withColumns(distances)
        .withColumn("is_reference_outlier", F.abs(f"{reference}_to_median") > far)
        .withColumn("is_target_outlier", F.abs(f"{target}_to_median") > far)
        .withColumn(
            "is_outlier",
            F.col("is_target_outlier") & (F.col("is_reference_outlier") | ~F.col("is_in_range")),
        )
    )


def drop_ambiguous(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Remove every row of a key that carries more than one non-missing value.

    Ambiguous keys are found by a map-side count and taken out by an anti join: the rows
    themselves are not gathered by key.
    """
    ambiguous = df.groupBy(*keys).agg(F.count(value).alias("_n")).where("_n > 1").select(*keys)
    return null_safe_join(df, ambiguous, keys, "left_anti")


def paired_series_errors(
    df: DataFrame,
    value: str,
    code: str,
    whole: str,
    part: str,
    keys: Sequence[str],
    time: str,
    threshold: float = 0.3,
) -> DataFrame:
    """Periods where whole and part disagree for one year only.

    The relation "whole exceeds part" flips against the previous available period and the
    whole makes a large log change that the next period takes back. Returns the keys.
    """
    ordered = by_time(keys, time)
    pairs = (
        df.where(F.col(code).isin(whole, part))
        .groupBy(*keys, time)
        .agg(
            F.max(F.when(F.col(code) == whole, F.col(value))).alias("_whole"),
            F.max(F.when(F.col(code) == part, F.col(value))).alias("_part"),
        )
        .where(F.col("_whole").isNotNull() | F.col("_part").isNotNull())
        .withColumn(
            "_exceeds", F.coalesce("_whole", F.lit(0.0)) > F.coalesce("_part", F.lit(0.0))
        )
        .withColumn("_flips", F.col("_exceeds") != F.lag("_exceeds").over(ordered))
        .withColumn("_change", log_change(F.col("_whole"), F.lag("_whole").over(ordered)))
        .withColumn("_change_next", F.lead("_change").over(ordered))
    )
    return pairs.where(
        F.col("_flips")
        & (F.abs("_change") > threshold)
        & (F.abs("_change_next") > threshold)
        & (F.signum("_change") != F.signum("_change_next"))
    ).select(*keys, time)
