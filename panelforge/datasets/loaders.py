"""Loaders: catalogue in, dataset out. Options mirror how the datasets are used."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from panelforge.constants import DATASET_VERSIONS, LATEST_VERSION
from panelforge.datasets import pipelines, tables
from panelforge.operators import fuels, hierarchy
from panelforge.operators.versions import stack_versions
from panelforge.sources.catalog import METADATA_TABLE, Catalog

# Tables that need no more than typed reading.
PLAIN_TABLES = {
    "facility_details": "2a_ProductionFacilityDetails",
    "facility_function": "2c_Function",
    "installation": "3_ProductionInstallation",
    "installation_activity": "3b_IEDAnnexIOtherActivity",
    "installation_bat_conclusions": "3d_BATConclusions",
    "installation_bat_derogations": "3e_BATDerogations",
    "installation_details": "3a_ProductionInstallationDetails",
    "installation_other_chapters": "3j_OtherRelevantChapters",
    "installation_permit": "3c_PermitDetails",
    "installation_stricter_permit": "3i_StricterPermitConditions",
    "part_details": "4a_ProductionInstallationPartDetails",
    "part_derogations": "4c_Derogations",
    "part_desulphurisation": "4b_DesulphurisationInformation",
}


def plain(catalog: Catalog, name: str, version: str = LATEST_VERSION) -> DataFrame:
    return catalog.reporting(PLAIN_TABLES[name], version)


def combustion_plants(catalog: Catalog) -> DataFrame:
    details = (
        "3_PlantDetails",
        "4_EnergyInputAndTotalEmissionsToAir",
        "5_OptOutsAndNERP",
        "6_LcpArt15",
    )
    return tables.plant_master(
        catalog.plants("1_BasicData"),
        catalog.plants("2_Plant"),
        *[catalog.plants(name) for name in details],
    )


def register_releases(catalog: Catalog) -> DataFrame:
    return tables.register_releases(
        catalog.register("POLLUTANTRELEASE"),
        catalog.register("FACILITYREPORT"),
        catalog.register("POLLUTANTRELEASEANDTRANSFERREPORT"),
    )


def register_facilities(catalog: Catalog) -> DataFrame:
    return tables.register_facilities(
        catalog.register("FACILITYREPORT"), catalog.register("FACILITYID_CHANGES")
    )


def register_reports(catalog: Catalog) -> DataFrame:
    return catalog.register("UPLOADEDREPORTS")


def register_activity(catalog: Catalog) -> DataFrame:
    return catalog.register("ACTIVITY")


def all_versions(
    catalog: Catalog, table: str, keys: list[str], versions: Iterable[str] = tuple(DATASET_VERSIONS)
) -> DataFrame:
    return stack_versions(
        catalog.spark, catalog.loader(table), catalog.loader(METADATA_TABLE), keys, versions
    )


def facilities(
    catalog: Catalog, versions: Iterable[str] = tuple(DATASET_VERSIONS)
) -> DataFrame:
    keys = ["reportingYear", "Parent_Site_INSPIRE_ID", "Facility_INSPIRE_ID"]
    return tables.facility_master(
        all_versions(catalog, "2_ProductionFacility", keys, versions),
        register_facilities(catalog),
        catalog.crosswalk("links-eprtr"),
        catalog.crosswalk("deduplication_facility"),
    )


def parts(catalog: Catalog, versions: Iterable[str] = tuple(DATASET_VERSIONS)) -> DataFrame:
    keys = ["reportingYear", "Parent_Installation_INSPIRE_ID", "Installation_Part_INSPIRE_ID"]
    return tables.part_master(
        all_versions(catalog, "4_ProductionInstallationPart", keys, versions),
        combustion_plants(catalog),
        catalog.crosswalk("links_lcp_part"),
    )


def identifiers(
    catalog: Catalog,
    include_name: bool = True,
    add_older_plants: bool = True,
    case_sensitive: bool = True,
    version: str = LATEST_VERSION,
) -> DataFrame:
    links = (
        (catalog.crosswalk("deduplication_lcpmapping"), catalog.crosswalk("links_lcp_facility"))
        if add_older_plants
        else (None, None)
    )
    return hierarchy.identifiers(
        catalog.reporting("1_ProductionSite", version),
        catalog.reporting("2_ProductionFacility", version),
        catalog.reporting("3_ProductionInstallation", version),
        catalog.reporting("4_ProductionInstallationPart", version),
        *links,
        include_name=include_name,
        case_sensitive=case_sensitive,
    )


def emissions_to_air(
    catalog: Catalog,
    balanced: bool = False,
    repaired: bool = False,
    add_older_plants: bool = True,
    version: str = LATEST_VERSION,
) -> DataFrame:
    data = catalog.reporting("4e_EmissionsToAir", version)
    if add_older_plants:
        data = fuels.append_older_emissions(
            data, combustion_plants(catalog), catalog.crosswalk("links_lcp_part")
        )
    return pipelines.emissions_to_air(data, balanced, repaired)


def energy_inputs(
    catalog: Catalog,
    repaired: bool = False,
    add_older_plants: bool = True,
    estimate_emissions: bool = True,
    version: str = LATEST_VERSION,
) -> DataFrame:
    data = catalog.reporting("4d_EnergyInput", version)
    if add_older_plants:
        data = fuels.append_older_fuels(
            data, combustion_plants(catalog), catalog.crosswalk("links_lcp_part")
        )
    factors = None
    if estimate_emissions:
        table = catalog.crosswalk("ipcc2006_table_2_2")
        factors = fuels.emission_factors(catalog.spark, table)
    if repaired:
        emissions = emissions_to_air(catalog, True, True, add_older_plants, version)
        return pipelines.energy_inputs(data, emissions, factors)
    return data if factors is None else fuels.estimate_co2(data, factors)


def pollutant_releases(
    catalog: Catalog,
    deduplicated: bool = True,
    repaired: bool = True,
    imputed: bool = False,
    version: str = LATEST_VERSION,
) -> DataFrame:
    clusters = catalog.crosswalk("deduplication_facility") if deduplicated else None
    return pipelines.pollutant_releases(
        catalog.reporting("2f_PollutantRelease", version), clusters, repaired, imputed
    )
