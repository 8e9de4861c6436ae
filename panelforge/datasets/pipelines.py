"""Cleaning pipelines as functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelforge.operators import anomaly, fuels, panel, repair
from panelforge.operators.crosswalk import apply_crosswalk
from panelforge.sources.staging import stage

YEAR = "reportingYear"
PART = "Installation_Part_INSPIRE_ID"
FACILITY = "Facility_INSPIRE_ID"


def energy_inputs(
    energy: DataFrame, emissions: DataFrame, factors: DataFrame | None = None
) -> DataFrame:
    """Standard fuels, full panel, repair against emissions, CO2 by emission factor."""
    standard = fuels.standardise_fuels(energy)
    standard = stage(standard, "standard_fuels")
    balanced = panel.balance(standard, YEAR, [PART, *repair.FUEL_KEY])
    repaired = repair.repair_energy(balanced, emissions)
    return repaired if factors is None else fuels.estimate_co2(repaired, factors)


def emissions_to_air(
    emissions: DataFrame, balanced: bool = False, repaired: bool = False
) -> DataFrame:
    """Full panel by part and pollutant, unit errors repaired."""
    keys = [PART, "pollutantCode"]
    if balanced:
        # Balancing reads its source for bounds, present periods and rows.
        emissions = panel.balance(stage(emissions, "emissions"), YEAR, keys)
    if repaired:
        emissions = anomaly.repair_units(emissions, "totalPollutantQuantityTNE", keys, YEAR)
    return emissions


def pollutant_releases(
    releases: DataFrame,
    clusters: DataFrame | None = None,
    repaired: bool = True,
    imputed: bool = False,
    strict_parity: bool = True,
) -> DataFrame:
    """Merge clusters, full panel, drop ambiguous keys, repair, optionally impute."""
    value = "totalPollutantQuantityKg"
    if clusters is not None:
        releases = apply_crosswalk(releases, clusters, FACILITY)
    if repaired:
        series = [FACILITY, "pollutantCode", "medium"]
        releases = panel.balance(stage(releases, "releases"), YEAR, series)
        releases = releases.where("pollutantCode IS NOT NULL AND medium IS NOT NULL")
        releases = anomaly.drop_ambiguous(releases, value, [*series, YEAR])
        # The panel is read for targets, proxies, bounds and the final update.
        releases = stage(releases, "release_panel")
        releases = repair.repair_releases(releases, strict_parity=strict_parity)
        releases = repair.void_biomass_errors(releases)
    if imputed:
        releases = repair.impute_from_ratios(releases)
    return releases
