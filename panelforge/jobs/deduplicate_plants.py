"""Facilities for plants that were reported as facilities of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.datasets import loaders
from panelforge.functions.text import clean, stop_words, strip_stop_words
from panelforge.jobs.common import LinkageSpec, link, location, main, near
from panelforge.linkage import levels as lv
from panelforge.linkage.blocking import block_on
from panelforge.linkage.score import threshold_weight
from panelforge.operators.crosswalk import best_match, enforce_one_to_one, unmapped_report
from panelforge.sources.catalog import CROSSWALKS, Catalog, schema_of
from panelforge.sources.sinks import write_ordered_csv

FACILITY, PART_NAME = "Facility_INSPIRE_ID", "nameOfFeature_Installation_Part"

# Fixed value: identifier scheme of plants without a facility.
UNMAPPED_SCHEME = "LCPmapping_unmapped_PlantId"
_SCHEME = "ProductionFacility_thematicIdScheme"
_KEPT = [
    "unique_id", FACILITY, "countryCode", "parentCompanyName", "nameOfFeature", PART_NAME,
    "ProductionFacility_thematicId", "streetName", "buildingNumber", "city", "postalCode",
    "mainActivityCode", "pointGeometryLat", "pointGeometryLon",
]


def _lower_address() -> dict:
    return {c: F.lower(c) for c in ("streetName", "city", "postalCode")}


def unmapped_plants(facilities: DataFrame) -> DataFrame:
    return facilities.where(F.col(_SCHEME) == UNMAPPED_SCHEME)


def plant_records(facilities: DataFrame, stop_list: DataFrame) -> DataFrame:
    owner = F.regexp_extract("parentCompanyName", r"parentCompany of plant:\s+(.*)", 1)
    plants = (
        unmapped_plants(facilities)
        .withColumn("parentCompanyName", owner)
        .withColumns({"parentCompanyName": clean("parentCompanyName", ["city"]), **_lower_address()})
        .withColumn(PART_NAME, F.col("parentCompanyName"))
        .withColumn(
            "unique_id", F.concat_ws("|", F.lit("plant"), FACILITY, "ProductionFacility_thematicId")
        )
        .select(*_KEPT)
    )
    return strip_stop_words(plants, stop_list, ["parentCompanyName", PART_NAME])


def parent_records(
    facilities: DataFrame, identifiers: DataFrame, releases: DataFrame, stop_list: DataFrame
) -> DataFrame:
    """Candidate parents, one record per facility and part name, largest emitters first."""
    scheme = F.col(_SCHEME)
    part_names = identifiers.select(FACILITY, PART_NAME).distinct()
    co2 = (
        releases.where("pollutantCode = 'CO2' AND medium = 'AIR'")
        .groupBy(FACILITY)
        .agg(F.sum("totalPollutantQuantityKg").alias("kgCO2"))
    )
    cleaned = {
        "parentCompanyName": clean("parentCompanyName", ["city"]),
        "nameOfFeature": clean("nameOfFeature", ["city", "parentCompanyName"]),
        PART_NAME: clean(PART_NAME, ["city", "parentCompanyName", "nameOfFeature"]),
        "ProductionFacility_thematicId": clean("ProductionFacility_thematicId"),
        **_lower_address(),
    }
    # Text that sorts by falling emissions stands in for a global row number; decimals keep
    # small differences apart, and unknown emissions sort behind all known ones.
    high = F.lit("1" + "0" * 31).cast("decimal(38,6)")
    below = (high - F.col("kgCO2").cast("decimal(38,6)")).cast("decimal(38,6)")
    rank = F.coalesce(F.lpad(below.cast("string"), 39, "0"), F.lit("~"))
    parents = (
        facilities.where(
            (F.col("facilityType") == "EPRTR") & (scheme.isNull() | (scheme != UNMAPPED_SCHEME))
        )
        .join(part_names, FACILITY, "inner")
        .join(co2, FACILITY, "left")
        .withColumn("_raw_part", F.coalesce(PART_NAME, F.lit("")))
        .withColumns(cleaned)
        .withColumn("unique_id", F.concat_ws("|", F.lit("parent"), rank, FACILITY, "_raw_part"))
        .select(*_KEPT)
    )
    names = ["parentCompanyName", "nameOfFeature", PART_NAME]
    return strip_stop_words(parents, stop_list, names)


def comparisons() -> tuple[lv.Comparison, ...]:
    # The left record is the parent, the right one the plant.
    holds_company = F.contains(F.col(f"{PART_NAME}_r"), F.col("parentCompanyName_l"))
    holds_feature = F.contains(F.col(f"{PART_NAME}_r"), F.col("nameOfFeature_l"))

    def close(threshold: float) -> lv.Level:
        contained = F.coalesce(holds_company, F.lit(False)) | F.coalesce(holds_feature, F.lit(False))
        return lv.any_of(
            lv.custom(contained, "parentCompanyName", "nameOfFeature", PART_NAME),
            lv.similar(PART_NAME, threshold, strict=True),
        )

    number = F.regexp_replace("ProductionFacility_thematicId_l", "^0+", "")
    identifier = ("ProductionFacility_thematicId", "parentCompanyName")
    address = lv.all_of(
        lv.exact("postalCode"), lv.similar("streetName", 0.9), lv.similar("buildingNumber", 0.9)
    )
    return (
        lv.compare(
            "name",
            lv.all_of(lv.null_level("parentCompanyName"), lv.null_level(PART_NAME)),
            lv.exact(PART_NAME),
            close(0.9),
            close(0.7),
            lv.otherwise(),
        ),
        location([address, near(1.0)], [10.0, 25.0, 50.0]),
        lv.exact_match("mainActivityCode", tf=True),
        lv.compare(
            "identifier",
            lv.null_when(
                F.col("ProductionFacility_thematicId_l").isNull()
                | F.col("parentCompanyName_r").isNull(),
                *identifier,
            ),
            lv.custom(
                F.contains(F.col("parentCompanyName_r"), number), *identifier
            ).with_fixed(0.9999, 0.0001),
            lv.otherwise(),
        ),
    )


def spec() -> LinkageSpec:
    by_country = [PART_NAME, "postalCode", "streetName", "city", "mainActivityCode"]
    return LinkageSpec(
        comparisons=comparisons(),
        rules=(block_on("countryCode"),),
        prior_rules=tuple(
            ("countryCode", c, "mainActivityCode") for c in ("city", "postalCode", "streetName")
        ),
        recall=0.7,
        training_rules=tuple(block_on("countryCode", c) for c in by_country),
        threshold=threshold_weight(0.5),
    )


def crosswalk(parents: DataFrame, plants: DataFrame) -> DataFrame:
    _, pairs = link(parents, plants, spec())
    best = best_match(pairs, f"{FACILITY}_r", "match_weight", ["unique_id_l"]).select(
        F.col(f"{FACILITY}_l").alias("Facility_INSPIRE_ID_cluster"),
        F.col(f"{FACILITY}_r").alias(FACILITY),
    )
    return enforce_one_to_one(best, FACILITY, "Facility_INSPIRE_ID_cluster").select(
        "Facility_INSPIRE_ID_cluster", FACILITY
    )


def still_unmapped(catalog: Catalog) -> DataFrame:
    """Plants the crosswalk leaves out, with their energy by part, largest first."""
    parts = loaders.identifiers(catalog).select(FACILITY, "Installation_Part_INSPIRE_ID")
    energy = loaders.energy_inputs(catalog).join(
        parts.distinct(), "Installation_Part_INSPIRE_ID", "left"
    )
    return unmapped_report(
        unmapped_plants(catalog.reporting("2_ProductionFacility")),
        catalog.crosswalk("deduplication_lcpmapping"),
        energy,
        FACILITY,
        ["Installation_Part_INSPIRE_ID"],
        "energyInputTJ",
        "tj",
    )


def legal_forms(catalog: Catalog) -> DataFrame:
    columns = [f.name for f in schema_of(CROSSWALKS["legal_forms"])]
    return stop_words(catalog.crosswalk("legal_forms"), columns)


def run(catalog: Catalog, output: str) -> None:
    facilities = catalog.reporting("2_ProductionFacility")
    stop_list = legal_forms(catalog)
    parents = parent_records(
        facilities,
        loaders.identifiers(catalog),
        catalog.reporting("2f_PollutantRelease"),
        stop_list,
    )
    write_ordered_csv(
        crosswalk(parents, plant_records(facilities, stop_list)),
        f"{output}/deduplication_lcpmapping.csv",
        ["Facility_INSPIRE_ID_cluster"],
    )


if __name__ == "__main__":
    main(run, "deduplicate-plants")
