"""Crosswalk from a facility's older identifier to the one that continues it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.datasets.loaders import all_versions, plain
from panelforge.functions.ordered import first_non_null, first_value, last_value
from panelforge.functions.text import clean
from panelforge.jobs.common import LinkageSpec, link, location, main, near
from panelforge.linkage import levels as lv
from panelforge.linkage.blocking import Rule, block_on
from panelforge.linkage.score import threshold_weight
from panelforge.operators.crosswalk import best_by_weight, enforce_one_to_one
from panelforge.sources.catalog import Catalog
from panelforge.sources.sinks import write_ordered_csv

FACILITY = "Facility_INSPIRE_ID"


def records(stacked: DataFrame, functions: DataFrame, releases: DataFrame) -> DataFrame:
    """One record per facility: first known attributes, activity years, first and last CO2."""
    attributes = [c for c in stacked.columns if c not in (FACILITY, "reportingYear")]
    facilities = stacked.groupBy(FACILITY).agg(
        *[first_non_null(c, "reportingYear").alias(c) for c in attributes]
    )
    activity = functions.groupBy(FACILITY).agg(
        F.max("NACEMainEconomicActivityCode").alias("NACEMainEconomicActivityCode")
    )
    is_co2 = (F.col("medium") == "AIR") & (F.col("pollutantCode") == "CO2")
    co2 = releases.where(is_co2).groupBy(FACILITY)
    co2 = co2.agg(
        first_value("totalPollutantQuantityKg", "reportingYear").alias("CO2_first"),
        last_value("totalPollutantQuantityKg", "reportingYear").alias("CO2_last"),
    )
    years = releases.groupBy(FACILITY).agg(
        F.min("reportingYear").alias("year_first"), F.max("reportingYear").alias("year_last")
    )
    named = {
        "parentCompanyName": clean("parentCompanyName", remove=["city"]),
        "nameOfFeature": clean("nameOfFeature", remove=["city", "parentCompanyName"]),
        "city": F.lower("city"),
        "postalCode": F.lower("postalCode"),
    }
    # Sorts like (first year, last year), missing years last, and stays unique.
    order = [F.coalesce(F.lpad(F.col(c).cast("string"), 4, "0"), F.lit("9999"))
             for c in ("year_first", "year_last")]
    return (
        facilities.withColumns(named)
        .withColumn("nameOfFeature", F.nullif("nameOfFeature", "parentCompanyName"))
        .join(activity, FACILITY, "left")
        .join(years, FACILITY, "left")
        .join(co2, FACILITY, "left")
        .withColumn("unique_id", F.concat_ws("|", *order, F.col(FACILITY)))
    )


def comparisons() -> tuple[lv.Comparison, ...]:
    company, feature = "parentCompanyName", "nameOfFeature"
    crossed = [(company, company), (feature, company), (company, feature)]

    def close(threshold: float) -> lv.Level:
        return lv.any_of(*[lv.similar(a, threshold, b, strict=True) for a, b in crossed])

    def co2_within(threshold: float) -> lv.Level:
        gap = F.abs(F.ln("CO2_last_l") - F.ln("CO2_first_r"))
        return lv.custom(gap < threshold, "CO2_last", "CO2_first")

    no_co2 = F.col("CO2_last_l").isNull() | F.col("CO2_first_l").isNull()
    nace, activity = "NACEMainEconomicActivityCode", "mainActivityCode"
    address = lv.all_of(lv.exact("postalCode"), lv.similar("streetName", 0.9))
    return (
        lv.compare(
            "company",
            lv.null_level(company),
            lv.any_of(*[lv.exact(a, b) for a, b in crossed]),
            close(0.9),
            close(0.7),
            lv.otherwise(),
        ),
        lv.name_match(feature, tf=True),
        location([address, near(1.0)], [5.0, 10.0, 25.0, 50.0]),
        lv.compare(
            "activity",
            lv.all_of(lv.null_level(nace), lv.null_level(activity)),
            lv.any_of(lv.exact(nace), lv.exact(activity)),
            lv.otherwise(),
        ),
        lv.compare(
            "CO2",
            lv.null_when(no_co2, "CO2_last", "CO2_first"),
            *[co2_within(t) for t in (0.1, 0.25, 0.5)],
            lv.otherwise(),
        ),
    )


def spec() -> LinkageSpec:
    follows = Rule(("countryCode",), before=("year_last", "year_first"))
    return LinkageSpec(
        comparisons=comparisons(),
        rules=(follows,),
        prior_rules=(
            (
                "countryCode",
                "parentCompanyName",
                "city",
                "postalCode",
                "mainActivityCode",
                "NACEMainEconomicActivityCode",
            ),
        ),
        recall=0.7,
        training_rules=(
            block_on("countryCode", "postalCode"),
            block_on("countryCode", "parentCompanyName"),
            block_on("countryCode", "nameOfFeature"),
            block_on("countryCode", "city", "mainActivityCode"),
        ),
        threshold=threshold_weight(0.9),
        directed=True,
    )


def crosswalk(data: DataFrame) -> DataFrame:
    """Best older identifier per newer one, without chains."""
    _, pairs = link(data, None, spec())
    ids = pairs.select(
        F.col(f"{FACILITY}_r").alias("Facility_INSPIRE_ID_cluster"),
        F.col(f"{FACILITY}_l").alias(FACILITY),
        "match_weight",
    )
    best = best_by_weight(ids, "Facility_INSPIRE_ID_cluster", FACILITY, "match_weight")
    return enforce_one_to_one(best, FACILITY, "Facility_INSPIRE_ID_cluster").select(
        "Facility_INSPIRE_ID_cluster", FACILITY
    )


def run(catalog: Catalog, output: str) -> None:
    keys = ["reportingYear", "Parent_Site_INSPIRE_ID", FACILITY]
    data = records(
        all_versions(catalog, "2_ProductionFacility", keys),
        plain(catalog, "facility_function"),
        catalog.reporting("2f_PollutantRelease"),
    )
    write_ordered_csv(
        crosswalk(data), f"{output}/deduplication_facility.csv", ["Facility_INSPIRE_ID_cluster"]
    )


if __name__ == "__main__":
    main(run, "deduplicate-facilities")
