"""Facilities for older plants without a part link, from plants that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.datasets import loaders
from panelforge.functions.text import clean
from panelforge.jobs.common import LinkageSpec, link, main
from panelforge.linkage import levels as lv
from panelforge.linkage.blocking import block_on
from panelforge.operators.crosswalk import edges_to_unlinked
from panelforge.sources.catalog import Catalog
from panelforge.sources.sinks import write_ordered_csv

PLANT, FACILITY, PART = "Unique_Plant_ID", "Facility_INSPIRE_ID", "Installation_Part_INSPIRE_ID"

# Generic words cut from plant names.
GENERIC_WORDS = ["kraftwerk", "central termoelectrica", "central termoeletrica"]


def records(plants: DataFrame, part_links: DataFrame, identifiers: DataFrame) -> DataFrame:
    """One record per plant with its facility where a linked part gives one."""
    generic = [F.lit(word) for word in GENERIC_WORDS]
    cleaned = {
        "PlantName": clean("PlantName", remove=["FacilityName", "Address1", "City", *generic]),
        "FacilityName": clean("FacilityName", remove=["Address1", "City", *generic]),
        "Address1": clean("Address1", remove=["City"]),
        **{c: clean(c) for c in ("Address2", "City", "PostalCode", "OtherSector")},
    }
    kept = [*cleaned, "Longitude", "Latitude", "Refineries", FACILITY]
    return (
        plants.join(part_links.select(PLANT, PART), PLANT, "left")
        .join(identifiers.select(FACILITY, PART), PART, "left")
        .withColumns(cleaned)
        .groupBy(PLANT)
        .agg(*[F.max(c).alias(c) for c in kept])
        .withColumn(
            "CountryCode", F.regexp_extract(F.upper(PLANT), r"([A-Z]{2})\d+", 1)
        )
    )


def comparisons() -> tuple[lv.Comparison, ...]:
    rings = [lv.within_km("Latitude", "Longitude", km) for km in (0.1, 1.0, 5.0)]
    return (
        lv.name_match("PlantName"),
        lv.name_match("FacilityName"),
        lv.compare(
            "distance", lv.null_level("Latitude", "Longitude"), *rings, lv.otherwise()
        ),
        lv.name_match("Address1"),
        lv.name_match("City"),
        lv.name_match("PostalCode", [0.95]),
        lv.exact_match("Refineries", tf=True),
        lv.exact_match("OtherSector", tf=True),
    )


def spec() -> LinkageSpec:
    return LinkageSpec(
        comparisons=comparisons(),
        rules=(block_on("CountryCode"),),
        prior_rules=((FACILITY,),),
        recall=0.9,
        training_rules=tuple(
            block_on("CountryCode", c)
            for c in ("PostalCode", "City", "PlantName", "Address1", "Refineries", "OtherSector")
        ),
        threshold=-1.0,
        unique_id=PLANT,
        max_pairs=1e7,
    )


def links(data: DataFrame) -> DataFrame:
    _, pairs = link(data, None, spec())
    return edges_to_unlinked(pairs, PLANT, FACILITY, "match_weight", ["match_probability"])


def run(catalog: Catalog, output: str) -> None:
    data = records(
        loaders.combustion_plants(catalog),
        catalog.crosswalk("links_lcp_part"),
        loaders.identifiers(catalog),
    )
    write_ordered_csv(links(data), f"{output}/links_lcp_facility.csv", [PLANT])


if __name__ == "__main__":
    main(run, "link-plants-to-facilities")
