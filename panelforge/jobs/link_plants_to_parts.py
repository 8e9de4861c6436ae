"""Links between older combustion plants and current installation parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.datasets import loaders
from panelforge.functions.ordered import first_value
from panelforge.functions.text import clean
from panelforge.jobs.common import LinkageSpec, link, location, main, near
from panelforge.linkage import levels as lv
from panelforge.linkage.blocking import block_on
from panelforge.linkage.score import threshold_weight
from panelforge.operators.crosswalk import best_match
from panelforge.sources.catalog import Catalog
from panelforge.sources.sinks import write_ordered_csv

PART, FACILITY = "Installation_Part_INSPIRE_ID", "Facility_INSPIRE_ID"


def part_records(
    parts: DataFrame,
    energy: DataFrame,
    identifiers: DataFrame,
    facilities: DataFrame,
    register_links: DataFrame,
    register_facilities: DataFrame,
) -> DataFrame:
    """Parts with first-year energy and the address and national id of their facility."""
    national = register_facilities.select("FacilityID", "NationalID").distinct()
    url_id = F.nullif(F.regexp_extract(FACILITY, r"/EW_EA-\d+\.FACILITY$", 0), F.lit(""))
    sites = (
        facilities.join(register_links.select(FACILITY, "FacilityID"), FACILITY, "left")
        .join(national, "FacilityID", "left")
        .withColumn(
            "NationalID", F.coalesce("NationalID", url_id, "ProductionFacility_thematicId")
        )
        .select(
            FACILITY,
            clean("NationalID").alias("ProductionFacility_thematicId"),
            "pointGeometryLon",
            "pointGeometryLat",
            "city",
            "postalCode",
            "countryCode",
        )
    )
    first_year = (
        energy.groupBy(PART, "reportingYear")
        .agg(F.sum("energyInputTJ").alias("energyInputTJ"))
        .groupBy(PART)
        .agg(first_value("energyInputTJ", "reportingYear").alias("energyInputTJ"))
    )
    return (
        parts.select(
            PART,
            clean("nameOfFeature").alias("nameOfFeature"),
            "ProductionInstallationPart_thematicId",
            F.col("withinRefinery").cast("int").alias("withinRefinery"),
            F.year("dateOfStartOfOperation").alias("yearOfStartOfOperation"),
            "totalRatedThermalInput",
        )
        .join(first_year, PART, "left")
        .join(identifiers.select(FACILITY, PART), PART, "left")
        .join(sites, FACILITY, "left")
        .drop(FACILITY)
        .withColumnRenamed(PART, "unique_id")
    )


def plant_records(
    basic: DataFrame, plants: DataFrame, details: DataFrame, energy: DataFrame
) -> DataFrame:
    """Plants as last reported; coordinates are filled from the plant's other years."""
    place = (
        plants.join(
            details.select(F.col("FK_Plant_ID").alias("ID")).distinct(), "ID", "left_semi"
        )
        .groupBy("Unique_Plant_ID")
        .agg(
            F.max("Longitude").alias("pointGeometryLon"),
            F.max("Latitude").alias("pointGeometryLat"),
        )
    )
    fuels = ("Biomass", "OtherSolidFuels", "LiquidFuels", "NaturalGas", "OtherGases")
    total = sum((F.col(f) for f in fuels[1:]), F.col(fuels[0]))
    rows = (
        plants.select(
            "ID", "FK_BasicData_ID", "Unique_Plant_ID", "EPRTRNationalId", "PlantName",
            "City", "PostalCode",
        )
        .join(
            details.select(
                F.col("FK_Plant_ID").alias("ID"), "Refineries", "DateOfStartOfOperation", "MWth"
            ),
            "ID",
        )
        .join(
            basic.select(F.col("ID").alias("FK_BasicData_ID"), "MemberState", "ReferenceYear"),
            "FK_BasicData_ID",
        )
        .join(
            energy.select(F.col("FK_Plant_ID").alias("ID"), total.alias("energyInputTJ")),
            "ID",
            "left",
        )
    )
    # A plant has at most one row per reference year; ties by row id.
    latest = Window.partitionBy("Unique_Plant_ID").orderBy(
        F.col("ReferenceYear").desc_nulls_last(), "ID"
    )
    year = F.regexp_extract("DateOfStartOfOperation", r"\d{4}", 0).try_cast("int")
    return (
        rows.withColumn("_rank", F.row_number().over(latest))
        .where("_rank = 1")
        .join(place, "Unique_Plant_ID", "left")
        .select(
            clean("PlantName").alias("nameOfFeature"),
            F.col("Unique_Plant_ID").alias("ProductionInstallationPart_thematicId"),
            F.col("Refineries").cast("int").alias("withinRefinery"),
            year.alias("yearOfStartOfOperation"),
            F.col("MWth").alias("totalRatedThermalInput"),
            "energyInputTJ",
            F.col("Unique_Plant_ID").alias("unique_id"),
            clean("EPRTRNationalId").alias("ProductionFacility_thematicId"),
            "pointGeometryLon",
            "pointGeometryLat",
            F.col("City").alias("city"),
            F.col("PostalCode").alias("postalCode"),
            F.when(F.col("MemberState") == "UK", "GB")
            .otherwise(F.col("MemberState"))
            .alias("countryCode"),
        )
    )


def comparisons() -> tuple[lv.Comparison, ...]:
    def measure(name: str, *steps: lv.Level) -> lv.Comparison:
        return lv.compare(name, lv.null_level(name), *steps, lv.otherwise())

    rated, started, energy = "totalRatedThermalInput", "yearOfStartOfOperation", "energyInputTJ"
    return (
        lv.exact_match("ProductionInstallationPart_thematicId"),
        lv.name_match("ProductionFacility_thematicId"),
        lv.name_match("nameOfFeature", tf=True),
        lv.exact_match("withinRefinery", tf=True),
        location(
            [near(0.1)],
            [1.0, 5.0, 10.0, 25.0, 50.0],
            lv.any_of(lv.exact("postalCode"), lv.exact("city")),
        ),
        measure(
            rated, lv.exact(rated), *[lv.within_share(rated, t) for t in (0.01, 0.05, 0.1, 0.25)]
        ),
        measure(started, lv.exact(started), *[lv.within_difference(started, t) for t in (1, 2)]),
        measure(energy, *[lv.within_share(energy, t) for t in (0.05, 0.1, 0.25)]),
    )


def spec() -> LinkageSpec:
    facility_id, part_id = "ProductionFacility_thematicId", "ProductionInstallationPart_thematicId"
    return LinkageSpec(
        comparisons=comparisons(),
        rules=(block_on("countryCode"),),
        prior_rules=(
            (facility_id,),
            (part_id,),
            ("countryCode", "city", "postalCode", "totalRatedThermalInput"),
        ),
        recall=0.6,
        training_rules=tuple(
            block_on("countryCode", c) for c in ("postalCode", facility_id, part_id, "city")
        ),
        threshold=threshold_weight(0.2),
        max_pairs=1e7,
    )


def links(parts: DataFrame, plants: DataFrame) -> DataFrame:
    """Best part per plant."""
    _, pairs = link(parts, plants, spec())
    best = best_match(pairs, "unique_id_r", "match_weight", ["unique_id_l"])
    return best.select(
        F.col("unique_id_r").alias("Unique_Plant_ID"),
        F.col("unique_id_l").alias(PART),
        "match_weight",
        "match_probability",
    )


def run(catalog: Catalog, output: str) -> None:
    parts = part_records(
        catalog.reporting("4_ProductionInstallationPart"),
        catalog.reporting("4d_EnergyInput"),
        loaders.identifiers(catalog),
        catalog.reporting("2_ProductionFacility"),
        catalog.crosswalk("links-eprtr"),
        loaders.register_facilities(catalog),
    )
    plants = plant_records(
        catalog.plants("1_BasicData"),
        catalog.plants("2_Plant"),
        catalog.plants("3_PlantDetails"),
        catalog.plants("4_EnergyInputAndTotalEmissionsToAir"),
    )
    write_ordered_csv(links(parts, plants), f"{output}/links_lcp_part.csv", ["Unique_Plant_ID"])


if __name__ == "__main__":
    main(run, "link-plants-to-parts")
