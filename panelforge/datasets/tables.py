"""Datasets as functions of typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.ordered import first_value
from panelforge.operators.crosswalk import apply_crosswalk
from panelforge.operators.joins import (
    rows_not_listed,
    star_join,
    union_distinct_by_name,
)
from panelforge.operators.panel import fill_from_latest
from panelforge.sources.staging import stage

FACILITY = "Facility_INSPIRE_ID"
PART = "Installation_Part_INSPIRE_ID"
YEAR = "reportingYear"


def plant_master(basic: DataFrame, plants: DataFrame, *details: DataFrame) -> DataFrame:
    """Older combustion plants: reference year, plant and all detail tables in one row."""
    driver = basic.select(F.col("ID").alias("FK_BasicData_ID"), "ReferenceYear").join(
        plants.withColumnRenamed("ID", "FK_Plant_ID"), "FK_BasicData_ID", "left"
    )
    return star_join(driver, details, "FK_Plant_ID")


def register_releases(
    releases: DataFrame, facility_reports: DataFrame, reports: DataFrame
) -> DataFrame:
    """Older register: releases with the facility and year of their report."""
    years = reports.select("PollutantReleaseAndTransferReportID", "ReportingYear")
    facilities = (
        facility_reports.select(
            "FacilityID", "FacilityReportID", "PollutantReleaseAndTransferReportID"
        )
        .distinct()
        .join(years, "PollutantReleaseAndTransferReportID", "left")
    )
    return releases.join(facilities, "FacilityReportID", "left")


def register_facilities(facility_reports: DataFrame, changes: DataFrame) -> DataFrame:
    """Older register: facility reports with their reporting year."""
    years = changes.select("CountryCode", "FacilityReportID", "ReportingYear")
    return facility_reports.join(years, ["CountryCode", "FacilityReportID"], "left")


def best_register_links(links: DataFrame) -> DataFrame:
    """Heaviest facility per older register id."""
    # Missing weights come last, in descending order as well.
    heaviest = -F.col("match_weight")
    return links.groupBy("FacilityID").agg(first_value(FACILITY, heaviest).alias(FACILITY))


def facility_master(
    stacked: DataFrame,
    older: DataFrame,
    links: DataFrame,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """Facilities per year: all versions, older register years that are missing, filled.

    ``stacked`` is the latest row per key over all versions, ``older`` the register's
    facilities with year, ``links`` the scored links between the two.
    """
    # All versions in one table: read for the union and for the keys it already has.
    stacked = stage(stacked, "facility_versions")
    mapped = older.join(best_register_links(links), "FacilityID", "inner").select(
        FACILITY,
        F.col("ReportingYear").alias(YEAR),
        F.col("ParentCompanyName").alias("parentCompanyName"),
        F.col("FacilityName").alias("nameOfFeature"),
    )
    combined = union_distinct_by_name(stacked, rows_not_listed(mapped, stacked, FACILITY, YEAR))
    combined = stage(combined, "facility_years")
    attributes = [c for c in combined.columns if c not in (FACILITY, YEAR)]
    filled = fill_from_latest(combined, attributes, [FACILITY], YEAR)
    return filled if clusters is None else apply_crosswalk(filled, clusters, FACILITY)


def part_master(stacked: DataFrame, plants: DataFrame, links: DataFrame) -> DataFrame:
    """Parts per year: all versions plus totals of linked older plants."""
    older = (
        plants.join(links.select("Unique_Plant_ID", PART), "Unique_Plant_ID", "inner")
        .groupBy(PART, F.col("ReferenceYear").alias(YEAR))
        .agg(
            F.sum("MWth").alias("totalRatedThermalInput"),
            F.max("Refineries").cast("int").alias("withinRefinery"),
            F.max("OptOutPlant").alias("optOutPlant"),
        )
    )
    combined = union_distinct_by_name(stacked, older)
    return combined.withColumn("optOutPlant", F.coalesce("optOutPlant", F.lit(False)))
