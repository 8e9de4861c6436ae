"""A small catalogue of generated CSV files with every table of the three databases."""

from __future__ import annotations

import csv
import os
import random

from panelforge.constants import DATASET_VERSIONS
from panelforge.operators.fuels import CO2_DEFAULT
from panelforge.sources.catalog import CROSSWALKS, METADATA_TABLE, schema_of
from panelforge.sources.plant_tables import PLANT_TABLES
from panelforge.sources.register_tables import REGISTER_TABLES
from panelforge.sources.reporting_tables import REPORTING_TABLES

VERSIONS = ["v14", "v15", "v16"]
N = 60
COUNTRIES = ["DE", "FR", "ES"]
YEARS = range(2012, 2022)
WORDS = ["nord", "sued", "west", "ost", "alpha", "beta", "gamma", "delta", "omega", "sigma"]


def _write(path: str, ddl: str, rows: list[dict]) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    names = [f.name for f in schema_of(ddl)]
    with open(path, "w", newline="") as handle:
        writer = csv.DictWriter(handle, names + ["notDeclared"], restval="")
        writer.writeheader()
        writer.writerows(rows)


def site(i):
    rng = random.Random(i)
    name = f"{rng.choice(WORDS)} {rng.choice(WORDS)} werk {i}"
    return {
        "country": COUNTRIES[i % 3],
        "name": name,
        "company": f"{name} energie GmbH",
        "city": f"stadt {i // 3}",
        "postal": f"{10000 + i // 2}",
        "street": f"{rng.choice(WORDS)} strasse",
        "lat": 45 + i * 0.11,
        "lon": 5 + i * 0.07,
        "mw": 50.0 + 7 * i,
        "activity": f"1({'abc'[i % 3]})",
    }


def build(root: str) -> str:
    for version in VERSIONS:
        _reporting(f"{root}/reporting/{DATASET_VERSIONS[version]}", VERSIONS.index(version))
    _register(f"{root}/register")
    _plants(f"{root}/plants")
    _crosswalks(f"{root}/crosswalks")
    return root


def _reporting(folder: str, v: int) -> None:
    rows = {name: [] for name in REPORTING_TABLES}
    for y in YEARS:
        rows[METADATA_TABLE].append(
            {"fileId": y, "filename": f"f{y}.xml", "countryCode": "DE", "reportingYear": y,
             "dateSubmitted": f"0{v + 1}/15/{(y + 1) % 100:02d} 10:00:00"}
        )
    for i in range(N):
        s = site(i)
        place = {"pointGeometryLat": s["lat"], "pointGeometryLon": s["lon"]}
        rows["1_ProductionSite"].append(
            {"fileId_EUReg": 2020, "Site_INSPIRE_ID": f"S{i}", "nameOfFeature": f"Site {i}",
             "countryCode": s["country"], **place}
        )
        for y in (2019, 2020) if i % 2 else (2020,):
            rows["2_ProductionFacility"].append(
                {"fileId_EUReg": y, "Parent_Site_INSPIRE_ID": f"S{i}",
                 "Facility_INSPIRE_ID": f"F{i}", "ProductionFacility_thematicId": f"{i:07d}",
                 "parentCompanyName": s["company"] if i % 7 else "CONFIDENTIAL",
                 "nameOfFeature": s["name"] if i % 3 else f"{s['name']} v{v}", "facilityType": "EPRTR",
                 "streetName": s["street"], "buildingNumber": str(i), "city": s["city"],
                 "postalCode": s["postal"], "countryCode": s["country"],
                 "mainActivityCode": s["activity"], "dateOfStartOfOperation": "01/15/75 00:00:00",
                 **place}
            )
        # Plants reported as facilities of their own.
        if i % 4 == 0:
            rows["2_ProductionFacility"].append(
                {"fileId_EUReg": 2020, "Parent_Site_INSPIRE_ID": f"S{i}",
                 "Facility_INSPIRE_ID": f"U{i}", "ProductionFacility_thematicId": f"U{i:07d}",
                 "ProductionFacility_thematicIdScheme": "LCPmapping_unmapped_PlantId",
                 "parentCompanyName": f"parentCompany of plant: {s['name']} {i:07d}",
                 "streetName": s["street"], "buildingNumber": str(i), "city": s["city"],
                 "postalCode": s["postal"], "countryCode": s["country"],
                 "mainActivityCode": s["activity"], **place}
            )
        rows["3_ProductionInstallation"].append(
            {"fileId_EUReg": 2020, "Parent_Facility_INSPIRE_ID": f"F{i}",
             "Installation_INSPIRE_ID": f"I{i}", "nameOfFeature": f"Inst {i}"}
        )
        rows["4_ProductionInstallationPart"].append(
            {"fileId_EUReg": 2020, "Parent_Installation_INSPIRE_ID": f"I{i}",
             "Installation_Part_INSPIRE_ID": f"P{i}", "nameOfFeature": f"{s['name']}",
             "ProductionInstallationPart_thematicId": f"{s['country']}{i:04d}",
             "totalRatedThermalInput": s["mw"], "withinRefinery": i % 2,
             "dateOfStartOfOperation": f"06/01/{60 + i % 35} 00:00:00"}
        )
        rows["2c_Function"].append(
            {"FunctionId": i, "Facility_INSPIRE_ID": f"F{i}",
             "NACEMainEconomicActivityCode": f"35.{i % 4}"}
        )
        for y in range(2016, 2022):
            wobble = 1 + ((i * 7 + y) % 5) / 50
            wrong = 1000 if (i, y) == (5, 2018) else 1
            for code, share in (("CO2", 1e6), ("NOX", 1e3), ("SOX", 2e3), ("CO2EXCLBIOMASS", 1e6)):
                rows["2f_PollutantRelease"].append(
                    {"Facility_INSPIRE_ID": f"F{i}", "reportingYear": y, "pollutantCode": code,
                     "medium": "AIR", "totalPollutantQuantityKg": s["mw"] * share * wobble}
                )
            for code in ("NOX", "SO2", "DUST"):
                rows["4e_EmissionsToAir"].append(
                    {"Installation_Part_INSPIRE_ID": f"P{i}", "reportingYear": y,
                     "pollutantCode": code, "totalPollutantQuantityTNE": s["mw"] * wobble}
                )
            rows["4d_EnergyInput"].append(
                {"Installation_Part_INSPIRE_ID": f"P{i}", "reportingYear": y,
                 "fuelInputCode": "Coal" if i % 2 else "NaturalGas",
                 "energyInputTJ": s["mw"] * 10 * wobble * wrong}
            )
    for name, ddl in REPORTING_TABLES.items():
        _write(f"{folder}/{name}.csv", ddl, rows[name])


def _register(folder: str) -> None:
    rows = {name: [] for name in REGISTER_TABLES}
    for r, y in enumerate(range(2012, 2018)):
        rows["POLLUTANTRELEASEANDTRANSFERREPORT"].append(
            {"PollutantReleaseAndTransferReportID": r, "ReportingYear": y, "CountryCode": "DE"}
        )
        for i in range(N):
            s, report = site(i), r * 1000 + i
            rows["FACILITYREPORT"].append(
                {"FacilityReportID": report, "PollutantReleaseAndTransferReportID": r,
                 "FacilityID": 9000 + i, "NationalID": f"N-{i}", "ParentCompanyName": s["company"],
                 "FacilityName": s["name"], "StreetName": s["street"], "BuildingNumber": str(i),
                 "City": s["city"], "PostalCode": s["postal"], "CountryCode": s["country"],
                 "Lat": s["lat"], "Long": s["lon"], "MainIAActivityCode": s["activity"]}
            )
            rows["FACILITYID_CHANGES"].append(
                {"CountryCode": s["country"], "ReportingYear": y, "FacilityReportID": report}
            )
            rows["POLLUTANTRELEASE"].append(
                {"PollutantReleaseID": report, "FacilityReportID": report,
                 "ReleaseMediumCode": "AIR", "PollutantCode": "CO2",
                 "TotalQuantity": s["mw"] * 1e6 * (1 + ((i * 7 + y) % 5) / 50)}
            )
    for name, ddl in REGISTER_TABLES.items():
        _write(f"{folder}/{name}.csv", ddl, rows[name])


def _plants(folder: str) -> None:
    rows = {name: [] for name in PLANT_TABLES}
    key = 0
    for b, y in enumerate(range(2012, 2016)):
        for c in COUNTRIES:
            basic = b * 10 + COUNTRIES.index(c)
            rows["1_BasicData"].append({"ID": basic, "MemberState": c, "ReferenceYear": y})
        for i in range(N):
            s, key = site(i), key + 1
            plant = f"{s['country']}{i:04d}"
            common = {"FK_Plant_ID": key, "Unique_Plant_ID": plant, "PlantName": s["name"]}
            rows["2_Plant"].append(
                {"ID": key, "FK_BasicData_ID": b * 10 + i % 3, "Unique_Plant_ID": plant,
                 "PlantName": s["name"], "FacilityName": s["company"], "EPRTRNationalId": f"N-{i}",
                 "Address1": s["street"], "City": s["city"], "PostalCode": s["postal"],
                 "Longitude": s["lon"], "Latitude": s["lat"]}
            )
            rows["3_PlantDetails"].append(
                {"ID": key, **common, "MWth": s["mw"], "Refineries": str(i % 2 == 1).lower(),
                 "DateOfStartOfOperation": f"01/06/{1960 + i % 35}", "OtherSector": "heat"}
            )
            rows["4_EnergyInputAndTotalEmissionsToAir"].append(
                {"ID": key, **common, "Biomass": 0, "OtherSolidFuels": s["mw"] * 10 * (i % 2),
                 "LiquidFuels": 0, "NaturalGas": s["mw"] * 10 * (1 - i % 2), "OtherGases": 0,
                 "SO2": s["mw"], "NOx": s["mw"], "Dust": s["mw"]}
            )
            rows["5_OptOutsAndNERP"].append(
                {"ID": key, **common, "OptOutPlant": str(i % 5 == 0).lower()}
            )
            rows["6_LcpArt15"].append({"ID": key, **common, "OperatingHours": 100.5})
    for name, ddl in PLANT_TABLES.items():
        _write(f"{folder}/{name}.csv", ddl, rows[name])


def _crosswalks(folder: str) -> None:
    rows = {name: [] for name in CROSSWALKS}
    for i in range(N):
        plant = f"{site(i)['country']}{i:04d}"
        scores = {"match_weight": 10, "match_probability": 0.999}
        rows["links-eprtr"].append({"Facility_INSPIRE_ID": f"F{i}", "FacilityID": 9000 + i, **scores})
        if i < N // 2:
            rows["links_lcp_part"].append(
                {"Unique_Plant_ID": plant, "Installation_Part_INSPIRE_ID": f"P{i}", **scores}
            )
    rows["links_lcp_facility"] = [
        {"Unique_Plant_ID": "DE9999", "Facility_INSPIRE_ID": "F0", "match_weight": 3,
         "match_probability": 0.9}
    ]
    rows["deduplication_facility"] = [
        {"Facility_INSPIRE_ID_cluster": "F1", "Facility_INSPIRE_ID": "F2"}
    ]
    rows["deduplication_lcpmapping"] = [
        {"Facility_INSPIRE_ID_cluster": "F0", "Facility_INSPIRE_ID": "U0"}
    ]
    rows["ipcc2006_table_2_2"] = [
        {"Fuel": fuel, "CO2_Default": value} for fuel, value in CO2_DEFAULT.items()
    ]
    rows["legal_forms"] = [
        {"Entity Legal Form name Local name": "Gesellschaft;GmbH",
         "Abbreviations Local language": "GmbH;AG"}
    ]
    for name, ddl in CROSSWALKS.items():
        _write(f"{folder}/{name}.csv", ddl, rows[name])
