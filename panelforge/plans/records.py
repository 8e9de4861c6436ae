"""Queries: records that the linkage jobs compare, from tables shaped like the databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.jobs import deduplicate_facilities, link_plants_to_parts
from panelforge.plans.derived import table
from panelforge.plans.registry import query


def _squash(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '[^\w\s]', '', 'g'))"


def _clean(text: str, *remove: str) -> str:
    result = _squash(f"strip_accents({text})")
    for part in remove:
        result = f"replace({result}, coalesce({_squash(part)}, ''), '')"
    return f"nullif(trim({result}), '')"


# --- older plants ---------------------------------------------------------------------

_PLANTS = {
    "ID": "o_orderkey",
    "FK_BasicData_ID": "{year}",
    "Unique_Plant_ID": "concat('P', o_custkey)",
    "EPRTRNationalId": "CASE WHEN o_orderkey % 3 > 0 THEN concat('N.', o_custkey, '/é') END",
    "PlantName": "concat(o_orderpriority, ' Wérk-', o_custkey % 50)",
    "City": "concat('Stadt ', o_custkey % 20)",
    "PostalCode": "CASE WHEN o_custkey % 6 > 0 THEN concat('0', o_custkey % 90) END",
    "Longitude": "CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 360 AS DOUBLE) - 180 END",
    "Latitude": "CASE WHEN o_orderkey % 4 > 1 THEN CAST(o_orderkey % 180 AS DOUBLE) - 90 END",
}
_DETAILS = {
    "FK_Plant_ID": "o_orderkey",
    "Refineries": "o_orderstatus = 'F'",
    "DateOfStartOfOperation": "CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' "
    "ELSE concat('since ', {year} - 20, '-01-01') END",
    "MWth": "o_totalprice",
}
_ENERGY = {"FK_Plant_ID": "o_orderkey"} | {
    name: f"CASE WHEN o_orderkey % 97 <> {k} THEN o_totalprice * {k + 1} END"
    for k, name in enumerate(
        ("Biomass", "OtherSolidFuels", "LiquidFuels", "NaturalGas", "OtherGases")
    )
}
_BASIC = {
    "ID": "{year}",
    "MemberState": "CASE {year} % 3 WHEN 0 THEN 'UK' WHEN 1 THEN 'DE' ELSE 'FR' END",
    "ReferenceYear": "{year}",
}


def _selected(columns: dict[str, str], year: str) -> str:
    return ", ".join(f"{sql.format(year=year)} AS {name}" for name, sql in columns.items())


def _sql_of(columns: dict[str, str], where: str = "true", distinct: str = "") -> str:
    year = "CAST(year(o_orderdate) AS INTEGER)"
    return f"SELECT {distinct} {_selected(columns, year)} FROM orders WHERE {where}"


def _frame_of(orders: DataFrame, columns: dict[str, str], where: str = "true") -> DataFrame:
    chosen = orders.where(where)
    return chosen.selectExpr(
        *[f"{sql.format(year='year(o_orderdate)')} AS {name}" for name, sql in columns.items()]
    )


_DETAILED, _MEASURED = "o_orderkey % 10 <> 9", "o_orderkey % 5 <> 0"


@query(
    "plant_records",
    f"""
    WITH plants AS ({_sql_of(_PLANTS)}), details AS ({_sql_of(_DETAILS, _DETAILED)}),
    energy AS ({_sql_of(_ENERGY, _MEASURED)}), basic AS ({_sql_of(_BASIC, distinct="DISTINCT")}),
    place AS (
        SELECT Unique_Plant_ID, max(Longitude) AS lon, max(Latitude) AS lat FROM plants
        WHERE ID IN (SELECT FK_Plant_ID FROM details) GROUP BY 1
    ),
    latest AS (
        SELECT * FROM plants p JOIN details d ON d.FK_Plant_ID = p.ID
        JOIN basic b ON b.ID = p.FK_BasicData_ID
        LEFT JOIN energy e ON e.FK_Plant_ID = p.ID
        QUALIFY row_number() OVER (
            PARTITION BY p.Unique_Plant_ID ORDER BY ReferenceYear DESC NULLS LAST, p.ID) = 1
    )
    SELECT {_clean("PlantName")} AS nameOfFeature,
           Unique_Plant_ID AS ProductionInstallationPart_thematicId,
           CAST(Refineries AS INTEGER) AS withinRefinery,
           TRY_CAST(nullif(regexp_extract(DateOfStartOfOperation, '[0-9]{{4}}'), '') AS INTEGER)
               AS yearOfStartOfOperation,
           MWth AS totalRatedThermalInput,
           Biomass + OtherSolidFuels + LiquidFuels + NaturalGas + OtherGases AS energyInputTJ,
           Unique_Plant_ID AS unique_id,
           {_clean("EPRTRNationalId")} AS ProductionFacility_thematicId,
           lon AS pointGeometryLon, lat AS pointGeometryLat, City AS city, PostalCode AS postalCode,
           CASE WHEN MemberState = 'UK' THEN 'GB' ELSE MemberState END AS countryCode
    FROM latest LEFT JOIN place USING (Unique_Plant_ID)
    """,
)
def plant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants as last reported, with the place of their other years."""
    orders = table(spark, sf_dir, "orders")
    return link_plants_to_parts.plant_records(
        _frame_of(orders, _BASIC).distinct(),
        _frame_of(orders, _PLANTS),
        _frame_of(orders, _DETAILS, _DETAILED),
        _frame_of(orders, _ENERGY, _MEASURED),
    )


# --- facilities -----------------------------------------------------------------------

_STACKED = {
    "Facility_INSPIRE_ID": "concat('F', o_custkey)",
    "reportingYear": "{year}",
    "parentCompanyName": "CASE WHEN o_orderkey % 4 > 0 THEN concat(o_orderpriority, ' Société') END",
    "nameOfFeature": "CASE WHEN o_orderkey % 5 > 0 "
    "THEN concat(o_orderpriority, ' Société werk Stadt ', o_custkey % 3) END",
    "city": "concat('Stadt ', o_custkey % 3)",
    "postalCode": "CASE WHEN o_orderkey % 3 > 0 THEN concat('AB ', o_custkey % 90) END",
}
_ACTIVITY = {
    "Facility_INSPIRE_ID": "concat('F', o_custkey)",
    "NACEMainEconomicActivityCode": "o_orderpriority",
}
_RELEASES_SQL = """
    SELECT concat('F', o_custkey) AS Facility_INSPIRE_ID, {year} AS reportingYear,
           CASE WHEN o_custkey % 3 = 0 THEN 'AIR' ELSE 'WATER' END AS medium,
           CASE WHEN o_custkey % 2 = 0 THEN 'CO2' ELSE 'NOX' END AS pollutantCode,
           max(o_totalprice) AS totalPollutantQuantityKg
    FROM {orders} WHERE o_custkey % 11 <> 0 GROUP BY o_custkey, {year}
"""


def _first_known(name: str) -> str:
    return f"(list({name} ORDER BY reportingYear, {name}) FILTER ({name} IS NOT NULL))[1] AS {name}"


@query(
    "facility_records",
    f"""
    WITH stacked AS ({_sql_of(_STACKED)}), activity AS ({_sql_of(_ACTIVITY, "o_orderkey % 2 = 0")}),
    releases AS ({_RELEASES_SQL.format(year="CAST(year(o_orderdate) AS INTEGER)", orders="orders")}),
    facilities AS (
        SELECT Facility_INSPIRE_ID, {", ".join(_first_known(c) for c in list(_STACKED)[2:])}
        FROM stacked GROUP BY 1
    ),
    co2 AS (
        SELECT Facility_INSPIRE_ID, arg_min(totalPollutantQuantityKg, reportingYear) AS CO2_first,
               arg_max(totalPollutantQuantityKg, reportingYear) AS CO2_last
        FROM releases WHERE medium = 'AIR' AND pollutantCode = 'CO2' GROUP BY 1
    ),
    years AS (
        SELECT Facility_INSPIRE_ID, min(reportingYear) AS year_first, max(reportingYear) AS year_last
        FROM releases GROUP BY 1
    ),
    named AS (
        SELECT Facility_INSPIRE_ID, {_clean("parentCompanyName", "city")} AS parentCompanyName,
               {_clean("nameOfFeature", "city", "parentCompanyName")} AS feature,
               lower(city) AS city, lower(postalCode) AS postalCode
        FROM facilities
    )
    SELECT Facility_INSPIRE_ID, parentCompanyName,
           nullif(feature, parentCompanyName) AS nameOfFeature, city, postalCode,
           NACEMainEconomicActivityCode, year_first, year_last, CO2_first, CO2_last,
           concat_ws('|', coalesce(lpad(CAST(year_first AS VARCHAR), 4, '0'), '9999'),
                     coalesce(lpad(CAST(year_last AS VARCHAR), 4, '0'), '9999'),
                     Facility_INSPIRE_ID) AS unique_id
    FROM named
    LEFT JOIN (SELECT Facility_INSPIRE_ID, max(NACEMainEconomicActivityCode)
                      AS NACEMainEconomicActivityCode FROM activity GROUP BY 1)
         USING (Facility_INSPIRE_ID)
    LEFT JOIN years USING (Facility_INSPIRE_ID) LEFT JOIN co2 USING (Facility_INSPIRE_ID)
    """,
)
def facility_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per facility: first known attributes, years of activity, first and last CO2."""
    orders = table(spark, sf_dir, "orders")
    releases = spark.sql(
        _RELEASES_SQL.format(year="year(o_orderdate)", orders="{orders}"), orders=orders
    )
    return deduplicate_facilities.records(
        _frame_of(orders, _STACKED),
        _frame_of(orders, _ACTIVITY, "o_orderkey % 2 = 0"),
        releases,
    )
