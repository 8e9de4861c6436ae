"""Repairs that use a related series as a yardstick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.constants import RANGE_TOLERANCE
from panelforge.functions.series import (
    by_time,
    log_change,
    magnitude,
    median,
    over_unit,
    shift_magnitude,
)
from panelforge.operators.anomaly import flag_jumps, flag_outliers, paired_series_errors
from panelforge.operators.joins import null_safe_join
from panelforge.operators.panel import interpolate
from panelforge.sources.staging import stage

FUEL_KEY = ("fuelInputCode", "otherSolidFuelCode", "otherGaseousFuelCode")


def select_proxies(
    df: DataFrame,
    unit: str,
    value: str,
    target: tuple[str, str],
    minimum: int = 5,
    top: int = 3,
) -> DataFrame:
    """Per unit the best-observed positive series other than the target.

    Ranked by medium, number of observations (most first) and pollutant code. The ranking
    sees one row per series, after a map-side count.
    """
    medium, code = target
    counts = (
        df.where(
            ~((F.col("pollutantCode") == code) & (F.col("medium") == medium))
            & (F.col(value) > 0.0)
        )
        .groupBy(unit, "medium", "pollutantCode")
        .agg(F.count(F.lit(1)).alias("observations"))
        .where(F.col("observations") > minimum)
    )
    order = Window.partitionBy(unit).orderBy(
        F.col("medium").asc_nulls_last(),
        F.col("observations").desc(),
        F.col("pollutantCode").asc_nulls_last(),
    )
    return counts.withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= top
    ).drop("_rank")


def release_ratios(
    df: DataFrame, unit: str, time: str, value: str, target: tuple[str, str]
) -> DataFrame:
    """Target series next to each selected proxy, with ratio proxy / target."""
    medium, code = target
    targets = df.where((F.col("pollutantCode") == code) & (F.col("medium") == medium)).select(
        time, unit, "medium", "pollutantCode", F.col(value).alias("target")
    )
    proxies = df.join(
        select_proxies(df, unit, value, target), [unit, "medium", "pollutantCode"], "inner"
    ).select(
        time,
        unit,
        F.col("medium").alias("medium_proxy"),
        F.col("pollutantCode").alias("pollutantCode_proxy"),
        F.col(value).alias("proxy"),
    )
    ratio = F.when(
        (F.col("target") > 0.0) & (F.col("proxy") > 0.0),
        F.try_divide(F.col("proxy"), F.col("target")),
    )
    return targets.join(proxies, [unit, time], "left").withColumn("ratio", ratio).drop("proxy")


def repair_releases(
    df: DataFrame,
    unit: str = "Facility_INSPIRE_ID",
    time: str = "reportingYear",
    value: str = "totalPollutantQuantityKg",
    target: tuple[str, str] = ("AIR", "CO2"),
    strict_parity: bool = True,
) -> DataFrame:
    """Rescale target values that every proxy series says are off by powers of ten.

    With ``strict_parity`` a year qualifies once every available ratio has *a verdict*;
    without it every verdict must be "outlier".
    """
    medium, code = target
    series = ["medium", "pollutantCode"]
    # Read once for the ratios, three times for the quantile band.
    ratios = stage(release_ratios(df, unit, time, value, target), "release_ratios")
    judged = flag_outliers(
        ratios,
        reference="ratio",
        target="target",
        identifiers=[unit],
        groups=[*series, "medium_proxy", "pollutantCode_proxy"],
        time=time,
        threshold_quantile=0.95,
        threshold_outlier=2.0,
    )
    counted = F.col("is_outlier").isNotNull() if strict_parity else F.col("is_outlier")
    scalars = (
        judged.groupBy(unit, time)
        .agg(
            F.count("ratio").alias("_ratios"),
            F.count_if(counted).alias("_verdicts"),
            magnitude(median(F.col("ratio_to_median"))).alias("_scalar"),
        )
        .where((F.col("_ratios") > 0) & (F.col("_ratios") == F.col("_verdicts")))
        .select(unit, time, "_scalar")
    )
    is_target = (F.col("pollutantCode") == code) & (F.col("medium") == medium)
    bounds = (
        df.where(is_target)
        .groupBy(unit)
        .agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    )
    fixes = scalars.where(F.col("_scalar").isNotNull()).join(bounds, unit)
    scaled = F.col(value) * F.pow(F.lit(10.0), F.col("_scalar"))
    usable = (
        is_target & F.col("_scalar").isNotNull()
        & scaled.between(0.5 * F.col("_min"), 1.5 * F.col("_max"))
    )
    return (
        df.join(fixes, [unit, time], "left")
        .withColumn(value, F.when(usable, scaled).otherwise(F.col(value)))
        .select(*df.columns)
    )


def void_biomass_errors(
    df: DataFrame,
    unit: str = "Facility_INSPIRE_ID",
    time: str = "reportingYear",
    value: str = "totalPollutantQuantityKg",
    threshold: float = 0.3,
) -> DataFrame:
    """CO2 to air becomes missing where it clashes with CO2 excluding biomass for one year."""
    errors = paired_series_errors(
        df.where(F.col("medium") == "AIR"),
        value,
        "pollutantCode",
        whole="CO2",
        part="CO2EXCLBIOMASS",
        keys=[unit],
        time=time,
        threshold=threshold,
    ).withColumn("_error", F.lit(True))
    void = (
        (F.col("pollutantCode") == "CO2")
        & (F.col("medium") == "AIR")
        & F.coalesce(F.col("_error"), F.lit(False))
    )
    return (
        df.join(errors, [unit, time], "left")
        .withColumn(value, F.when(~F.coalesce(void, F.lit(False)), F.col(value)))
        .select(*df.columns)
    )


def impute_from_ratios(
    df: DataFrame,
    unit: str = "Facility_INSPIRE_ID",
    time: str = "reportingYear",
    value: str = "totalPollutantQuantityKg",
    target: tuple[str, str] = ("AIR", "CO2"),
    proxies: Sequence[tuple[str, str]] = (("AIR", "NOX"), ("AIR", "SOX")),
) -> DataFrame:
    """Fill missing target values from proxies and their interpolated ratio to the target."""

    def is_series(series: tuple[str, str]) -> Column:
        return (F.col("medium") == series[0]) & (F.col("pollutantCode") == series[1])

    is_proxy = F.lit(False)
    for proxy in proxies:
        is_proxy = is_proxy | is_series(proxy)
    targets = df.where(is_series(target)).select(unit, time, F.col(value).alias("_target"))
    proxy_rows = df.where(is_proxy).select(
        unit,
        time,
        F.col("pollutantCode").alias("_proxy_code"),
        F.col("medium").alias("_proxy_medium"),
        F.col(value).alias("_proxy"),
    )
    ratios = targets.join(proxy_rows, [unit, time], "left").withColumn(
        "_ratio",
        F.when(F.col("_target") > 0.0, F.try_divide(F.col("_proxy"), F.col("_target"))),
    )
    bridged = interpolate(ratios, "_ratio", [unit, "_proxy_code", "_proxy_medium"], time)
    imputed = (
        bridged.withColumn(
            "_imputed",
            F.when(F.col("_ratio") > 0, F.try_divide(F.col("_proxy"), F.col("_ratio"))),
        )
        .groupBy(unit, time)
        .agg(F.avg("_imputed").alias("_imputed"))
    )
    filled = F.when(is_series(target), F.coalesce(F.col(value), F.col("_imputed"))).otherwise(
        F.col(value)
    )
    return df.join(imputed, [unit, time], "left").withColumn(value, filled).select(*df.columns)


def energy_ratios(
    energy: DataFrame, emissions: DataFrame, unit: str, time: str, value: str, quantity: str
) -> DataFrame:
    """Total energy of a unit next to each of its pollutants, with ratio energy / emission.

    Carries the jump verdict on the total, computed before the join fans it out.
    """
    totals = energy.groupBy(unit, time).agg(F.sum(value).alias("target"))
    totals = flag_jumps(
        totals, "target", [unit], time, 0.75, RANGE_TOLERANCE, "_target_scalar", "_target_jumps"
    ).drop("_target_scalar")
    proxies = emissions.groupBy(unit, time, "pollutantCode").agg(F.sum(quantity).alias("proxy"))
    ratio = F.when(F.col("proxy") > 0.0, F.try_divide(F.col("target"), F.col("proxy")))
    return totals.join(proxies, [unit, time], "left").withColumn("ratio", ratio)


def energy_scalars(ratios: DataFrame, unit: str, time: str) -> DataFrame:
    """Per unit and period: power of ten by which energy jumps, and by which it is off."""
    keys = [unit, "pollutantCode"]
    jumps = flag_jumps(
        ratios, "ratio", keys, time, 0.75, RANGE_TOLERANCE, "_ratio_scalar", "_ratio_jumps"
    )
    judged = flag_outliers(jumps, "ratio", "target", [unit], ["pollutantCode"], time, 0.99, 2.0)
    both = F.col("_target_jumps") & F.col("_ratio_jumps")
    return judged.groupBy(unit, time).agg(
        F.max(F.when(both, F.col("_ratio_scalar"))).alias("_jump"),
        magnitude(median(F.col("ratio_to_median"))).alias("_off"),
    )


def energy_inferred(ratios: DataFrame, unit: str, time: str) -> DataFrame:
    """Actual total next to the total inferred from emissions and the interpolated ratio."""
    judged = flag_outliers(ratios, "ratio", "target", [unit], ["pollutantCode"], time, 0.99, 2.0)
    kept = judged.withColumn("ratio", F.when(~F.coalesce("is_outlier", F.lit(False)), F.col("ratio")))
    bridged = interpolate(kept, "ratio", [unit, "pollutantCode"], time)
    return bridged.groupBy(unit, time).agg(
        F.max("target").alias("total_actual"),
        median(F.col("ratio") * F.col("proxy")).alias("total_inferred"),
    )


def repair_energy(
    energy: DataFrame,
    emissions: DataFrame,
    unit: str = "Installation_Part_INSPIRE_ID",
    time: str = "reportingYear",
    value: str = "energyInputTJ",
    quantity: str = "totalPollutantQuantityTNE",
    fuel_key: Sequence[str] = FUEL_KEY,
) -> DataFrame:
    """Rescale or void fuel inputs that contradict the unit's emissions.

    ``energy`` is a balanced panel by unit and fuel, ``emissions`` balanced and repaired.
    """
    # Read once for the verdicts, three times for the quantile band.
    ratios = stage(
        energy_ratios(energy, emissions, unit, time, value, quantity), "energy_ratios"
    )
    scalars = energy_scalars(ratios, unit, time)
    series = [unit, *fuel_key]
    v, off = F.col(value), F.col("_off")
    regular = F.when(off.isNull(), v)
    staged = (
        energy.join(scalars, [unit, time], "left")
        .withColumns(
            {
                "_large": F.abs(log_change(v, F.lag(v).over(by_time(series, time)))) > 0.5,
                "_global": median(regular).over(over_unit(series)),
                "_local": median(F.when(off.isNull() & (v > 0.0), v)).over(
                    by_time(series, time).rowsBetween(-2, 2)
                ),
            }
        )
        .withColumn("_median", F.coalesce("_local", "_global"))
        .withColumn(
            "_distance",
            F.when(
                off.isNotNull() & (F.col("_median") > 0.0) & (v > 0.0),
                F.round(F.log10(F.try_divide(v, F.col("_median")))),
            ),
        )
        .withColumn(
            "_own_off",
            F.when(F.abs("_distance") >= off, F.nullif(F.col("_distance"), F.lit(0.0))),
        )
    )

    def plausible(scaled: Column) -> Column:
        return scaled.between(
            F.least("_global", "_local") * 0.1, F.greatest("_global", "_local") * 2.0
        )

    by_jump = shift_magnitude(v, F.col("_jump"))
    by_own = shift_magnitude(v, F.col("_own_off"))
    false_zero = off.isNotNull() & (F.col("_median") >= 100.0) & (v == 0.0)
    repaired = (
        F.when(F.col("_jump").isNotNull() & F.col("_large") & plausible(by_jump), by_jump)
        .when(F.col("_own_off").isNotNull() & plausible(by_own), by_own)
        .when(false_zero, F.lit(None))
        .otherwise(v)
    )
    return staged.withColumn(value, repaired).select(*energy.columns)


def audit_repair(
    raw: DataFrame,
    repaired: DataFrame,
    keys: Sequence[str],
    value: str,
    tolerance: float = 1.0,
) -> DataFrame:
    """Raw and repaired total per key, with what happened to it."""

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum(value).alias(name))

    sides = total(raw, "raw_value").join(total(repaired, "repaired_value"), list(keys), "outer")
    changed = F.abs(F.col("raw_value") - F.col("repaired_value")) > tolerance
    voided = F.col("raw_value").isNotNull() & F.col("repaired_value").isNull()
    return sides.withColumn("is_changed", F.coalesce(changed, F.lit(False))).withColumn(
        "is_voided", voided
    )


def compare_totals(
    raw: DataFrame, repaired: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Raw and repaired totals below each other, tagged by source."""

    def total(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum(value).alias(value)).withColumn("source", F.lit(tag))

    return total(raw, "raw").unionByName(total(repaired, "repaired"))
