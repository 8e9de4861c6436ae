"""Loaders and linkage jobs on a generated catalogue with all tables."""

import glob

import pytest
from pyspark.sql import functions as F

from panelforge.datasets import loaders
from panelforge.jobs import (
    deduplicate_facilities,
    deduplicate_plants,
    link_plants_to_facilities,
    link_plants_to_parts,
    link_register,
)
from panelforge.sources.catalog import Catalog
from panelforge.sources.reporting_tables import REPORTING_TABLES
from tests.fixture_catalog import N, VERSIONS, build, site


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    return Catalog(spark, build(str(tmp_path_factory.mktemp("catalogue"))), "2026-01-01")


def plant(i):
    return f"{site(i)['country']}{i:04d}"


def test_plain_tables(catalog):
    for name in loaders.PLAIN_TABLES:
        assert loaders.plain(catalog, name).columns
    assert set(loaders.PLAIN_TABLES.values()) <= set(REPORTING_TABLES)
    assert loaders.plain(catalog, "facility_function").count() == N


def test_combustion_plants(catalog):
    plants = loaders.combustion_plants(catalog)
    assert plants.count() == 4 * N
    assert len(plants.columns) == len(set(plants.columns))
    assert {"ReferenceYear", "MWth", "NOx", "OptOutPlant", "ElvSO2"} <= set(plants.columns)


def test_register(catalog):
    releases = loaders.register_releases(catalog)
    assert releases.where("FacilityID IS NULL OR ReportingYear IS NULL").count() == 0
    assert loaders.register_facilities(catalog).count() == 6 * N
    assert loaders.register_reports(catalog).count() == 0
    assert loaders.register_activity(catalog).count() == 0


def test_facilities(catalog):
    data = loaders.facilities(catalog, VERSIONS)
    one = {r.reportingYear: r for r in data.where("Facility_INSPIRE_ID = 'F9'").collect()}
    # 2019 and 2020 from the latest version, 2012 to 2017 from the older register.
    assert sorted(one) == [2012, 2013, 2014, 2015, 2016, 2017, 2019, 2020]
    assert one[2020].nameOfFeature.endswith(" v2")
    assert one[2013].nameOfFeature == site(9)["name"]
    # Attributes only newer years report are filled back.
    assert one[2013].city == site(9)["city"]
    # F2 was merged into F1.
    assert data.where("Facility_INSPIRE_ID = 'F2'").count() == 0


def test_parts(catalog):
    data = loaders.parts(catalog, VERSIONS)
    one = {r.reportingYear: r for r in data.where("Installation_Part_INSPIRE_ID = 'P5'").collect()}
    assert sorted(one) == [2012, 2013, 2014, 2015, 2020]
    assert (one[2013].optOutPlant, one[2020].optOutPlant) == (True, False)
    assert one[2013].totalRatedThermalInput == pytest.approx(site(5)["mw"])
    assert one[2013].withinRefinery == 1


def test_identifiers(catalog):
    data = loaders.identifiers(catalog)
    row = data.where("Installation_Part_INSPIRE_ID = 'P7'").first()
    assert (row.Site_INSPIRE_ID, row.Facility_INSPIRE_ID, row.Installation_INSPIRE_ID) == (
        "S7", "F7", "I7",
    )
    assert data.where("Installation_Part_INSPIRE_ID = 'DE9999'").first().Facility_INSPIRE_ID == "F0"
    assert data.where("Facility_INSPIRE_ID = 'U0'").count() == 0
    lower = loaders.identifiers(catalog, include_name=False, case_sensitive=False)
    assert lower.where("Facility_INSPIRE_ID = 'f7'").count() >= 1
    assert "nameOfFeature" not in lower.columns


def test_energy_inputs(catalog):
    raw = loaders.energy_inputs(catalog)
    assert raw.where("reportingYear = 2013 AND Installation_Part_INSPIRE_ID = 'P5'").count() == 5
    # Older solid fuel of a part that burns only coal in 2016 and 2018 becomes coal.
    coal = raw.where("reportingYear = 2013 AND Installation_Part_INSPIRE_ID = 'P7'")
    assert coal.where("fuelInputCode = 'Coal'").first().energyInputTJ == pytest.approx(
        site(7)["mw"] * 10
    )
    fixed = loaders.energy_inputs(catalog, repaired=True)
    row = fixed.where(
        "Installation_Part_INSPIRE_ID = 'P5' AND reportingYear = 2018 AND fuelInputCode = 'Coal'"
    ).collect()
    assert len(row) == 1
    wobble = 1 + ((5 * 7 + 2018) % 5) / 50
    assert row[0].energyInputTJ == pytest.approx(site(5)["mw"] * 10 * wobble)
    assert row[0].tCO2 == pytest.approx(row[0].energyInputTJ * row[0].emission_factor_tCO2TJ)


def test_emissions_to_air(catalog):
    data = loaders.emissions_to_air(catalog, balanced=True, repaired=True)
    grid = data.groupBy("Installation_Part_INSPIRE_ID", "pollutantCode").count()
    assert {r["count"] for r in grid.collect()} == {10}


def test_pollutant_releases(catalog):
    data = loaders.pollutant_releases(catalog, imputed=True)
    assert data.where("Facility_INSPIRE_ID = 'F2'").count() == 0
    # Two values per key after the merge are ambiguous and go.
    assert data.where("Facility_INSPIRE_ID = 'F1'").count() == 0
    assert data.where("Facility_INSPIRE_ID = 'F3'").count() == 24


def read_csv(catalog, folder, name):
    assert glob.glob(f"{folder}/{name}.csv/part-*")
    return catalog.spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=True)


def test_link_register_job(catalog, tmp_path):
    link_register.run(catalog, str(tmp_path))
    got = read_csv(catalog, tmp_path, "links-eprtr").collect()
    right = sum(r.FacilityID == 9000 + int(r.Facility_INSPIRE_ID[1:]) for r in got
                if r.Facility_INSPIRE_ID.startswith("F"))
    assert right >= 0.9 * N


def test_link_plants_to_parts_job(catalog, tmp_path):
    link_plants_to_parts.run(catalog, str(tmp_path))
    got = {r.Unique_Plant_ID: r for r in read_csv(catalog, tmp_path, "links_lcp_part").collect()}
    right = sum(
        plant(i) in got and got[plant(i)].Installation_Part_INSPIRE_ID == f"P{i}" for i in range(N)
    )
    assert right >= 0.9 * N


def test_link_plants_to_facilities_job(catalog, tmp_path):
    link_plants_to_facilities.run(catalog, str(tmp_path))
    got = read_csv(catalog, tmp_path, "links_lcp_facility")
    assert got.columns == [
        "Unique_Plant_ID", "Facility_INSPIRE_ID", "match_weight", "match_probability",
    ]
    assert got.groupBy("Unique_Plant_ID").count().where("count > 1").count() == 0


def test_deduplicate_plants_job(catalog, tmp_path):
    deduplicate_plants.run(catalog, str(tmp_path))
    got = read_csv(catalog, tmp_path, "deduplication_lcpmapping").collect()
    pairs = {r.Facility_INSPIRE_ID: r.Facility_INSPIRE_ID_cluster for r in got}
    unmapped = [i for i in range(N) if i % 4 == 0]
    assert sum(pairs.get(f"U{i}") == f"F{i}" for i in unmapped) >= 0.8 * len(unmapped)
    report = deduplicate_plants.still_unmapped(catalog)
    assert report.columns == ["Facility_INSPIRE_ID", "Installation_Part_INSPIRE_ID", "tj"]


def test_deduplicate_facilities_job(catalog, spark):
    """A facility that stops and one that continues it at the same place."""
    stacked = loaders.all_versions(
        catalog,
        "2_ProductionFacility",
        ["reportingYear", "Parent_Site_INSPIRE_ID", "Facility_INSPIRE_ID"],
        VERSIONS,
    ).where(F.col("Facility_INSPIRE_ID").startswith("F"))
    old = stacked.where("CAST(substr(Facility_INSPIRE_ID, 2) AS INT) % 3 = 0").withColumn(
        "Facility_INSPIRE_ID", F.concat(F.lit("OLD"), "Facility_INSPIRE_ID")
    )
    releases = catalog.reporting("2f_PollutantRelease")
    old_releases = releases.where("CAST(substr(Facility_INSPIRE_ID, 2) AS INT) % 3 = 0").withColumns(
        {
            "Facility_INSPIRE_ID": F.concat(F.lit("OLD"), "Facility_INSPIRE_ID"),
            "reportingYear": F.col("reportingYear") - 8,
        }
    )
    functions = loaders.plain(catalog, "facility_function")
    old_functions = functions.withColumn(
        "Facility_INSPIRE_ID", F.concat(F.lit("OLD"), "Facility_INSPIRE_ID")
    )
    data = deduplicate_facilities.records(
        stacked.unionByName(old),
        functions.unionByName(old_functions),
        releases.unionByName(old_releases),
    )
    got = deduplicate_facilities.crosswalk(data).collect()
    assert got
    right = sum(r.Facility_INSPIRE_ID == f"OLD{r.Facility_INSPIRE_ID_cluster}" for r in got)
    assert right >= 0.8 * len(got)
    assert all(r.Facility_INSPIRE_ID.startswith("OLD") for r in got)


def test_factors_come_from_the_catalogue(catalog, monkeypatch):
    usual = loaders.energy_inputs(catalog).where("fuelInputCode = 'Coal'").first()
    read = type(catalog).crosswalk

    def doubled(self, name):
        table = read(self, name)
        if name == "ipcc2006_table_2_2":
            table = table.withColumn("CO2_Default", table.CO2_Default * 2)
        return table

    monkeypatch.setattr(type(catalog), "crosswalk", doubled)
    changed = loaders.energy_inputs(catalog).where("fuelInputCode = 'Coal'").first()
    assert changed.emission_factor_tCO2TJ == pytest.approx(2 * usual.emission_factor_tCO2TJ)
    assert changed.tCO2 / changed.energyInputTJ == pytest.approx(2 * usual.emission_factor_tCO2TJ)


def test_fuel_rows_are_read_once_and_combined(spark, tmp_path):
    """Equal rows are one before details are borrowed; the source is not read for each use."""
    from panelforge.operators.fuels import standardise_fuels

    rows = [("P1", 2001, "OtherGases", "old biogas", None, "Other", 2.0)] * 5 + [
        ("P1", 2002, "OtherGases", None, None, "Other", 1.5),
        ("P1", 2002, "OtherGases", "ignored", None, "Other", 0.0),
        ("P1", 2002, "OtherGases", None, None, "Other", None),
    ]
    schema = """Installation_Part_INSPIRE_ID string, reportingYear long, fuelInputCode string,
        furtherDetails string, otherSolidFuelCode string, otherGaseousFuelCode string,
        energyInputTJ double"""
    source = f"{tmp_path}/rows"
    spark.createDataFrame(rows, schema).write.parquet(source)
    standard = standardise_fuels(spark.read.parquet(source))
    got = [(r.reportingYear, r.fuelInputCode, r.energyInputTJ) for r in standard.collect()]
    assert sorted(got) == [(2001, "OtherGases", 10.0), (2002, "OtherGases", 1.5)]
    assert not any(source in name for name in standard.inputFiles())
