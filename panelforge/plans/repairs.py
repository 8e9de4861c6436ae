"""Queries: proxy-based repairs, fuels and the panel pipelines built from them.

Suppliers play reporting units; years, codes and quantities come from their line items.
Money is summed in whole cents so that sums do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.datasets import pipelines
from panelforge.operators import fuels, panel, repair
from panelforge.plans.derived import balanced_sql, corrupt, table, year_of
from panelforge.plans.panels import UNIT_ERROR, jumps_sql, outliers_sql, repaired_units_sql
from panelforge.plans.registry import query
from panelforge.sources.staging import stage

# --- releases -------------------------------------------------------------------------

_RELEASE_KEY = ["Facility_INSPIRE_ID", "pollutantCode", "medium"]


def _release_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, odd = F.col("l_returnflag"), F.col("l_linenumber") % 2 == 1
    code = (
        F.when(flag == "A", "CO2")
        .when(flag == "R", "SOX")
        .when(odd, "NOX")
        .otherwise("CO2EXCLBIOMASS")
    )
    medium = F.when(F.col("l_linestatus") == "F", "AIR").otherwise("WATER")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("unit"),
        code.alias("pollutantCode"),
        medium.alias("medium"),
        year_of("l_shipdate").alias("reportingYear"),
        F.col("l_quantity").alias("kg"),
    )


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per facility, pollutant, medium and year; some CO2 to air is mis-scaled."""
    cells = (
        _release_rows(spark, sf_dir)
        .groupBy("unit", "pollutantCode", "medium", "reportingYear")
        .agg(F.sum("kg").alias("kg"))
    )
    is_target = (F.col("pollutantCode") == "CO2") & (F.col("medium") == "AIR")
    kg = F.when(
        is_target, corrupt(F.col("kg"), F.col("unit"), F.col("reportingYear"))
    ).otherwise(F.col("kg"))
    return cells.select(
        F.concat(F.lit("F"), F.col("unit").cast("string")).alias("Facility_INSPIRE_ID"),
        "pollutantCode",
        "medium",
        "reportingYear",
        kg.alias("totalPollutantQuantityKg"),
    )


_RELEASES_SQL = """
    SELECT 'F' || unit AS Facility_INSPIRE_ID, pollutantCode, medium, reportingYear,
           CASE WHEN pollutantCode = 'CO2' AND medium = 'AIR'
                THEN CASE (unit * 7 + reportingYear) % 41
                     WHEN 0 THEN kg * 1000 WHEN 5 THEN kg / 1000 ELSE kg END
                ELSE kg END AS totalPollutantQuantityKg
    FROM (
        SELECT l_suppkey AS unit,
               CASE WHEN l_returnflag = 'A' THEN 'CO2' WHEN l_returnflag = 'R' THEN 'SOX'
                    WHEN l_linenumber % 2 = 1 THEN 'NOX' ELSE 'CO2EXCLBIOMASS' END
                   AS pollutantCode,
               CASE WHEN l_linestatus = 'F' THEN 'AIR' ELSE 'WATER' END AS medium,
               CAST(year(l_shipdate) AS BIGINT) AS reportingYear, sum(l_quantity) AS kg
        FROM lineitem GROUP BY 1, 2, 3, 4
    )
"""


def _proxies_sql(source: str) -> str:
    return f"""
        SELECT Facility_INSPIRE_ID, medium, pollutantCode, observations
        FROM (
            SELECT *, row_number() OVER (
                PARTITION BY Facility_INSPIRE_ID
                ORDER BY medium, observations DESC, pollutantCode) AS place
            FROM (
                SELECT Facility_INSPIRE_ID, medium, pollutantCode, count(*) AS observations
                FROM ({source})
                WHERE totalPollutantQuantityKg > 0
                  AND NOT (pollutantCode = 'CO2' AND medium = 'AIR')
                GROUP BY 1, 2, 3
            ) WHERE observations > 5
        ) WHERE place <= 3
    """


@query("proxy_selection", _proxies_sql(_RELEASES_SQL))
def proxy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.select_proxies(
        _releases(spark, sf_dir),
        "Facility_INSPIRE_ID",
        "totalPollutantQuantityKg",
        ("AIR", "CO2"),
    )


def repaired_releases_sql(source: str) -> str:
    """Releases with CO2 to air rescaled where the proxies agree on a power of ten."""
    ratios = """
        SELECT t.*, p.medium AS medium_proxy, p.pollutantCode AS code_proxy,
               CASE WHEN t.target > 0 AND p.kg > 0 THEN p.kg / t.target END AS ratio
        FROM tgt t LEFT JOIN (
            SELECT s.Facility_INSPIRE_ID, s.reportingYear, s.medium, s.pollutantCode,
                   s.totalPollutantQuantityKg AS kg
            FROM src s JOIN chosen c USING (Facility_INSPIRE_ID, medium, pollutantCode)
        ) p USING (Facility_INSPIRE_ID, reportingYear)
    """
    verdicts = outliers_sql(
        "SELECT * FROM ratios", "ratio", "target", ["Facility_INSPIRE_ID"],
        ["medium_proxy", "code_proxy"], "reportingYear", 0.95, 2.0,
    )
    return f"""
        WITH src AS ({source}),
        tgt AS (
            SELECT Facility_INSPIRE_ID, reportingYear, totalPollutantQuantityKg AS target
            FROM src WHERE pollutantCode = 'CO2' AND medium = 'AIR'
        ),
        chosen AS ({_proxies_sql("SELECT * FROM src")}),
        ratios AS ({ratios}),
        scalars AS (
            SELECT Facility_INSPIRE_ID, reportingYear, round(median(ratio_to_median)) AS power
            FROM ({verdicts}) GROUP BY 1, 2
            HAVING count(ratio) > 0 AND count(ratio) = count(is_outlier)
        ),
        bounds AS (
            SELECT Facility_INSPIRE_ID, min(target) AS lo, max(target) AS hi FROM tgt GROUP BY 1
        )
        SELECT src.* REPLACE (
            CASE WHEN pollutantCode = 'CO2' AND medium = 'AIR' AND power <> 0
                  AND totalPollutantQuantityKg * pow(10, power) >= 0.5 * lo
                  AND totalPollutantQuantityKg * pow(10, power) <= 1.5 * hi
                 THEN totalPollutantQuantityKg * pow(10, power)
                 ELSE totalPollutantQuantityKg END AS totalPollutantQuantityKg)
        FROM src LEFT JOIN scalars USING (Facility_INSPIRE_ID, reportingYear)
        LEFT JOIN bounds USING (Facility_INSPIRE_ID)
    """


def _rounded_releases_sql(source: str) -> str:
    return f"""
        SELECT Facility_INSPIRE_ID, pollutantCode, medium, reportingYear,
               round(totalPollutantQuantityKg, 6) AS totalPollutantQuantityKg
        FROM ({source})
    """


def _rounded(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.round(value, 6))


@query("proxy_repair_release", _rounded_releases_sql(repaired_releases_sql(_RELEASES_SQL)))
def proxy_repair_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    releases = stage(_releases(spark, sf_dir), "releases")
    repaired = repair.repair_releases(releases)
    return _rounded(repaired, "totalPollutantQuantityKg")


def voided_biomass_sql(source: str) -> str:
    return f"""
        WITH src_b AS ({source}),
        pair AS (
            SELECT Facility_INSPIRE_ID, reportingYear,
                   max(totalPollutantQuantityKg) FILTER (WHERE pollutantCode = 'CO2') AS a,
                   max(totalPollutantQuantityKg)
                       FILTER (WHERE pollutantCode = 'CO2EXCLBIOMASS') AS b
            FROM src_b WHERE medium = 'AIR' GROUP BY 1, 2
            HAVING a IS NOT NULL OR b IS NOT NULL
        ),
        step AS (
            SELECT *, coalesce(a, 0) > coalesce(b, 0) AS more,
                   lag(coalesce(a, 0) > coalesce(b, 0)) OVER w AS more_before,
                   CASE WHEN a > 0 AND lag(a) OVER w > 0 THEN log10(a / lag(a) OVER w) END AS c
            FROM pair WINDOW w AS (PARTITION BY Facility_INSPIRE_ID ORDER BY reportingYear)
        ),
        wrong AS (
            SELECT Facility_INSPIRE_ID, reportingYear, TRUE AS is_wrong FROM (
                SELECT *, lead(c) OVER (
                    PARTITION BY Facility_INSPIRE_ID ORDER BY reportingYear) AS c_next
                FROM step
            ) WHERE more <> more_before AND abs(c) > 0.3 AND abs(c_next) > 0.3
              AND sign(c) <> sign(c_next)
        )
        SELECT src_b.* REPLACE (
            CASE WHEN pollutantCode = 'CO2' AND medium = 'AIR' AND is_wrong THEN NULL
                 ELSE totalPollutantQuantityKg END AS totalPollutantQuantityKg)
        FROM src_b LEFT JOIN wrong USING (Facility_INSPIRE_ID, reportingYear)
    """


@query("biomass_consistency", _rounded_releases_sql(voided_biomass_sql(_RELEASES_SQL)))
def biomass_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    voided = repair.void_biomass_errors(_releases(spark, sf_dir))
    return _rounded(voided, "totalPollutantQuantityKg")


_GAPPED_SQL = f"""
    SELECT * REPLACE (
        CASE WHEN NOT (pollutantCode = 'CO2' AND medium = 'AIR' AND reportingYear % 3 = 0)
             THEN totalPollutantQuantityKg END AS totalPollutantQuantityKg)
    FROM ({_RELEASES_SQL})
"""


@query(
    "ratio_imputation",
    _rounded_releases_sql(f"""
        WITH src AS ({_GAPPED_SQL}),
        r AS (
            SELECT t.Facility_INSPIRE_ID, t.reportingYear, p.pollutantCode AS code,
                   p.totalPollutantQuantityKg AS proxy,
                   CASE WHEN t.totalPollutantQuantityKg > 0
                        THEN p.totalPollutantQuantityKg / t.totalPollutantQuantityKg END AS ratio
            FROM src t LEFT JOIN src p
              ON p.Facility_INSPIRE_ID = t.Facility_INSPIRE_ID
             AND p.reportingYear = t.reportingYear AND p.medium = 'AIR'
             AND p.pollutantCode IN ('NOX', 'SOX')
            WHERE t.pollutantCode = 'CO2' AND t.medium = 'AIR'
        ),
        edge AS (
            SELECT r.*,
                   (SELECT max(k.reportingYear) FROM r k WHERE k.ratio IS NOT NULL
                     AND k.Facility_INSPIRE_ID = r.Facility_INSPIRE_ID
                     AND k.code IS NOT DISTINCT FROM r.code
                     AND k.reportingYear < r.reportingYear) AS y0,
                   (SELECT min(k.reportingYear) FROM r k WHERE k.ratio IS NOT NULL
                     AND k.Facility_INSPIRE_ID = r.Facility_INSPIRE_ID
                     AND k.code IS NOT DISTINCT FROM r.code
                     AND k.reportingYear > r.reportingYear) AS y1
            FROM r
        ),
        line AS (
            SELECT e.Facility_INSPIRE_ID, e.reportingYear, e.proxy,
                   coalesce(e.ratio, a.ratio + (b.ratio - a.ratio)
                       * (e.reportingYear - e.y0)::DOUBLE / (e.y1 - e.y0)::DOUBLE) AS ratio
            FROM edge e
            LEFT JOIN r a ON a.Facility_INSPIRE_ID = e.Facility_INSPIRE_ID
                 AND a.code IS NOT DISTINCT FROM e.code AND a.reportingYear = e.y0
            LEFT JOIN r b ON b.Facility_INSPIRE_ID = e.Facility_INSPIRE_ID
                 AND b.code IS NOT DISTINCT FROM e.code AND b.reportingYear = e.y1
        ),
        guess AS (
            SELECT Facility_INSPIRE_ID, reportingYear,
                   avg(CASE WHEN ratio > 0 THEN proxy / ratio END) AS g
            FROM line GROUP BY 1, 2
        )
        SELECT src.* REPLACE (
            CASE WHEN pollutantCode = 'CO2' AND medium = 'AIR'
                 THEN coalesce(totalPollutantQuantityKg, g)
                 ELSE totalPollutantQuantityKg END AS totalPollutantQuantityKg)
        FROM src LEFT JOIN guess USING (Facility_INSPIRE_ID, reportingYear)
    """),
)
def ratio_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = (
        (F.col("pollutantCode") == "CO2")
        & (F.col("medium") == "AIR")
        & (F.col("reportingYear") % 3 == 0)
    )
    gapped = _releases(spark, sf_dir).withColumn(
        "totalPollutantQuantityKg", F.when(~gap, F.col("totalPollutantQuantityKg"))
    )
    return _rounded(repair.impute_from_ratios(gapped), "totalPollutantQuantityKg")


_CLUSTER_SQL = """
    SELECT 'F' || (s_suppkey - 1) AS cluster, 'F' || s_suppkey AS member
    FROM supplier WHERE s_suppkey % 10 = 1
"""


def _facility_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .where(key % 10 == 1)
        .select(
            F.concat(F.lit("F"), (key - 1).cast("string")).alias("Facility_INSPIRE_ID_cluster"),
            F.concat(F.lit("F"), key.cast("string")).alias("Facility_INSPIRE_ID"),
        )
    )


_MERGED_RELEASES_SQL = f"""
    SELECT coalesce(cluster, Facility_INSPIRE_ID) AS Facility_INSPIRE_ID, pollutantCode, medium,
           reportingYear, totalPollutantQuantityKg
    FROM ({_RELEASES_SQL}) LEFT JOIN ({_CLUSTER_SQL}) ON member = Facility_INSPIRE_ID
"""


def _panel_of_releases_sql() -> str:
    grid = balanced_sql(
        _MERGED_RELEASES_SQL, "reportingYear", _RELEASE_KEY, "totalPollutantQuantityKg"
    )
    return f"""
        SELECT * FROM ({grid})
        QUALIFY count(totalPollutantQuantityKg) OVER (
            PARTITION BY Facility_INSPIRE_ID, pollutantCode, medium, reportingYear) <= 1
    """


@query(
    "release_pipeline",
    _rounded_releases_sql(
        voided_biomass_sql(repaired_releases_sql(_panel_of_releases_sql()))
    ),
)
def release_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge clusters, balance, drop ambiguous keys, repair by proxies, check biomass."""
    cleaned = pipelines.pollutant_releases(
        _releases(spark, sf_dir), _facility_clusters(spark, sf_dir)
    )
    return _rounded(cleaned.select(*_RELEASE_KEY, "reportingYear", "totalPollutantQuantityKg"),
                    "totalPollutantQuantityKg")


# --- fuels ----------------------------------------------------------------------------

# Part types stand for fuels.
_FUEL_OF_TYPE = {
    "ECONOMY": "NaturalGas",
    "STANDARD": "OtherSolidFuels",
    "PROMO": "OtherGases",
    "SMALL": "Biomass",
    "MEDIUM": "LiquidFuels",
    "LARGE": "Coal",
}
_FUEL_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FUEL_OF_TYPE.items())
_ENERGY_ROWS_SQL = f"""
    SELECT 'P' || l_suppkey AS Installation_Part_INSPIRE_ID,
           CAST(year(l_shipdate) AS BIGINT) AS reportingYear,
           CASE p_type {_FUEL_CASES} ELSE 'Peat' END AS fuelInputCode,
           CASE WHEN p_type = 'STANDARD' THEN CASE p_partkey % 4
                WHEN 0 THEN 'Coal' WHEN 1 THEN 'Other' WHEN 2 THEN 'Lignite' END END
               AS otherSolidFuelCode,
           CASE WHEN p_type = 'PROMO' THEN CASE p_partkey % 5
                WHEN 0 THEN 'FurnaceGas' WHEN 1 THEN 'Other' WHEN 2 THEN 'CokeOvenGas' END END
               AS otherGaseousFuelCode,
           CASE WHEN l_partkey % 7 = 0 THEN p_name || ' Black Liquor'
                WHEN l_partkey % 11 = 0 THEN p_name || ' BIOGAS' END AS furtherDetails,
           CASE WHEN l_orderkey % 17 = 0 THEN 0.0 ELSE l_quantity END AS energyInputTJ
    FROM lineitem JOIN part ON p_partkey = l_partkey
"""


def _energy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    fuel = F.lit("Peat")
    for kind, code in reversed(_FUEL_OF_TYPE.items()):
        fuel = F.when(F.col("p_type") == kind, F.lit(code)).otherwise(fuel)
    solid = (
        F.when(key % 4 == 0, "Coal").when(key % 4 == 1, "Other").when(key % 4 == 2, "Lignite")
    )
    gas = (
        F.when(key % 5 == 0, "FurnaceGas")
        .when(key % 5 == 1, "Other")
        .when(key % 5 == 2, "CokeOvenGas")
    )
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lineitem.join(part, F.col("l_partkey") == key).select(
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias(
            "Installation_Part_INSPIRE_ID"
        ),
        year_of("l_shipdate").alias("reportingYear"),
        fuel.alias("fuelInputCode"),
        F.when(F.col("p_type") == "STANDARD", solid).alias("otherSolidFuelCode"),
        F.when(F.col("p_type") == "PROMO", gas).alias("otherGaseousFuelCode"),
        F.when(key % 7 == 0, F.concat("p_name", F.lit(" Black Liquor")))
        .when(key % 11 == 0, F.concat("p_name", F.lit(" BIOGAS")))
        .alias("furtherDetails"),
        F.when(F.col("l_orderkey") % 17 == 0, F.lit(0.0))
        .otherwise(F.col("l_quantity"))
        .alias("energyInputTJ"),
    )


def _borrowed_sql(column: str) -> str:
    known = f"CASE WHEN energyInputTJ > 0 THEN {column} END"
    window = f"""PARTITION BY Installation_Part_INSPIRE_ID, fuelInputCode
        ORDER BY reportingYear, {known} NULLS FIRST"""
    return f"""coalesce({known},
        first_value({known} IGNORE NULLS) OVER (
            {window} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
        last_value({known} IGNORE NULLS) OVER (
            {window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS {column}"""


def standard_fuels_sql(source: str) -> str:
    return f"""
        SELECT Installation_Part_INSPIRE_ID, reportingYear,
               coalesce(otherSolidFuelCode, otherGaseousFuelCode, fuelInputCode) AS fuelInputCode,
               max(otherSolidFuelCode) AS otherSolidFuelCode,
               max(otherGaseousFuelCode) AS otherGaseousFuelCode,
               sum(energyInputTJ) AS energyInputTJ
        FROM (
            SELECT * REPLACE (
                CASE WHEN otherSolidFuelCode <> 'Other' THEN otherSolidFuelCode END
                    AS otherSolidFuelCode,
                CASE WHEN otherGaseousFuelCode = 'Other' THEN NULL
                     WHEN otherGaseousFuelCode = 'FurnaceGas' THEN 'BlastFurnaceGas'
                     WHEN lower(furtherDetails) LIKE '%black liquor%'
                       OR lower(furtherDetails) LIKE '%licor negro%'
                       OR lower(furtherDetails) LIKE '%ablauge%' THEN 'Biomass'
                     WHEN lower(furtherDetails) LIKE '%biogas%' THEN 'Biomass'
                     ELSE otherGaseousFuelCode END AS otherGaseousFuelCode)
            FROM (
                SELECT Installation_Part_INSPIRE_ID, reportingYear, fuelInputCode, energyInputTJ,
                       {_borrowed_sql("furtherDetails")},
                       {_borrowed_sql("otherSolidFuelCode")},
                       {_borrowed_sql("otherGaseousFuelCode")}
                FROM ({source})
            )
        )
        GROUP BY 1, 2, 3
    """


@query("fuel_standardise", standard_fuels_sql(_ENERGY_ROWS_SQL))
def fuel_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuels.standardise_fuels(_energy_rows(spark, sf_dir))


_FACTOR_ROWS = ", ".join(
    f"('{code}', {fuels.CO2_DEFAULT[fuel]})" for fuel, code in fuels.FACTOR_FUEL_TO_CODE.items()
)
_FACTORS_SQL = f"""
    SELECT code, avg(kg) / 1000.0 AS factor FROM (VALUES {_FACTOR_ROWS}) AS f(code, kg) GROUP BY 1
"""


def _with_co2_sql(source: str) -> str:
    return f"""
        SELECT Installation_Part_INSPIRE_ID, reportingYear, fuelInputCode, otherSolidFuelCode,
               otherGaseousFuelCode, round(energyInputTJ, 6) AS energyInputTJ,
               round(factor, 6) AS emission_factor_tCO2TJ, round(energyInputTJ * factor, 4) AS tCO2
        FROM ({source}) LEFT JOIN ({_FACTORS_SQL}) ON code = fuelInputCode
    """


def _rounded_energy(df: DataFrame) -> DataFrame:
    return df.select(
        "Installation_Part_INSPIRE_ID",
        "reportingYear",
        "fuelInputCode",
        "otherSolidFuelCode",
        "otherGaseousFuelCode",
        F.round("energyInputTJ", 6).alias("energyInputTJ"),
        F.round("emission_factor_tCO2TJ", 6).alias("emission_factor_tCO2TJ"),
        F.round("tCO2", 4).alias("tCO2"),
    )


@query("emission_factors", _with_co2_sql(standard_fuels_sql(_ENERGY_ROWS_SQL)))
def emission_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    standard = fuels.standardise_fuels(_energy_rows(spark, sf_dir))
    return _rounded_energy(fuels.estimate_co2(standard, fuels.emission_factors(spark)))


# Years move from 1995-2001 to 2015-2021 so that the bridge years 2016 and 2018 exist.
_SOLID_SQL = f"""
    SELECT Installation_Part_INSPIRE_ID, reportingYear + 20 AS reportingYear, fuelInputCode,
           sum(energyInputTJ) AS energyInputTJ
    FROM (
        SELECT 'P' || l_suppkey || '-' || l_partkey % 5 AS Installation_Part_INSPIRE_ID,
               reportingYear, fuelInputCode, energyInputTJ
        FROM (
            SELECT l_suppkey, l_partkey, CAST(year(l_shipdate) AS BIGINT) AS reportingYear,
                   CASE l_orderkey % 9 WHEN 0 THEN 'Coal' WHEN 1 THEN 'Lignite'
                        ELSE 'OtherSolidFuels' END AS fuelInputCode,
                   CASE WHEN l_quantity > 30 THEN l_quantity ELSE 0.0 END AS energyInputTJ
            FROM lineitem
        )
    ) GROUP BY 1, 2, 3
"""


@query(
    "othersolid_unique_map",
    f"""
    WITH src AS ({_SOLID_SQL}),
    solid AS (
        SELECT Installation_Part_INSPIRE_ID, max(fuelInputCode) AS solid FROM src
        WHERE energyInputTJ > 0 AND reportingYear IN (2016, 2018)
          AND fuelInputCode IN ('Coal', 'Lignite', 'Peat')
        GROUP BY 1 HAVING count(DISTINCT fuelInputCode) = 1
    )
    SELECT Installation_Part_INSPIRE_ID, reportingYear, energyInputTJ,
           CASE WHEN fuelInputCode = 'OtherSolidFuels' THEN coalesce(solid, fuelInputCode)
                ELSE fuelInputCode END AS fuelInputCode
    FROM src LEFT JOIN solid USING (Installation_Part_INSPIRE_ID)
    """,
)
def othersolid_unique_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuels.map_solid_fuels(_solid_rows(spark, sf_dir))


def _solid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("l_orderkey") % 9
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(
                F.lit("P"),
                F.col("l_suppkey").cast("string"),
                F.lit("-"),
                (F.col("l_partkey") % 5).cast("string"),
            ).alias("Installation_Part_INSPIRE_ID"),
            (year_of("l_shipdate") + 20).alias("reportingYear"),
            F.when(slot == 0, "Coal")
            .when(slot == 1, "Lignite")
            .otherwise("OtherSolidFuels")
            .alias("fuelInputCode"),
        )
        .agg(
            F.sum(
                F.when(F.col("l_quantity") > 30, F.col("l_quantity")).otherwise(F.lit(0.0))
            ).alias("energyInputTJ")
        )
    )


# --- energy ---------------------------------------------------------------------------

_EMISSION_KEY = ["Installation_Part_INSPIRE_ID", "pollutantCode"]
_EMISSIONS_SQL = """
    SELECT 'P' || unit AS Installation_Part_INSPIRE_ID, pollutantCode, reportingYear,
           CASE (unit * 7 + reportingYear) % 41 WHEN 7 THEN t * 1000 ELSE t END
               AS totalPollutantQuantityTNE
    FROM (
        SELECT l_suppkey AS unit,
               CASE l_returnflag WHEN 'A' THEN 'NOX' WHEN 'N' THEN 'SO2' ELSE 'DUST' END
                   AS pollutantCode,
               CAST(year(l_shipdate) AS BIGINT) AS reportingYear,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS t
        FROM lineitem GROUP BY 1, 2, 3
    )
"""


def _emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("unit"),
            F.when(flag == "A", "NOX")
            .when(flag == "N", "SO2")
            .otherwise("DUST")
            .alias("pollutantCode"),
            year_of("l_shipdate").alias("reportingYear"),
        )
        .agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0).alias("t"))
    )
    wrong = (F.col("unit") * 7 + F.col("reportingYear")) % 41 == 7
    return cells.select(
        F.concat(F.lit("P"), F.col("unit").cast("string")).alias("Installation_Part_INSPIRE_ID"),
        "pollutantCode",
        "reportingYear",
        F.when(wrong, F.col("t") * 1000).otherwise(F.col("t")).alias("totalPollutantQuantityTNE"),
    )


# --- older plants ---------------------------------------------------------------------

# Measures of the older database's plants, by what tells their orders apart.
_PLANT_FUELS = {
    "Biomass": "1-URGENT",
    "OtherSolidFuels": "2-HIGH",
    "LiquidFuels": "3-MEDIUM",
    "NaturalGas": "4-NOT SPECIFIED",
    "OtherGases": "5-LOW",
}
_PLANT_EMISSIONS = {"NOx": "F", "SO2": "O", "Dust": "P"}


def _plants_sql(column: str, measures: dict[str, str], shift: int) -> str:
    sums = ", ".join(
        f"CAST(sum(CASE WHEN {column} = '{value}' THEN CAST(round(o_totalprice) AS BIGINT) END)"
        f" AS DOUBLE) AS {name}"
        for name, value in measures.items()
    )
    return f"""
    SELECT 'C' || (o_custkey % 500) AS Unique_Plant_ID,
           CAST(year(o_orderdate) + {shift} AS BIGINT) AS ReferenceYear, {sums}
    FROM orders GROUP BY 1, 2
    """


def _plants(
    spark: SparkSession, sf_dir: str, column: str, measures: dict[str, str], shift: int
) -> DataFrame:
    price = F.round("o_totalprice").cast("long")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.concat(F.lit("C"), (F.col("o_custkey") % 500).cast("string")).alias(
                "Unique_Plant_ID"
            ),
            (year_of("o_orderdate") + shift).alias("ReferenceYear"),
        )
        .agg(
            *[
                F.sum(F.when(F.col(column) == value, price)).cast("double").alias(name)
                for name, value in measures.items()
            ]
        )
    )


def _part_links(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    """Every second plant is linked to a part, some parts to two plants."""
    key = F.col("s_suppkey")
    part = F.concat(F.lit("P"), F.ceil(key / 2).cast("string"), F.lit(ending))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("C"), (key * 2).cast("string")).alias("Unique_Plant_ID"),
        part.alias("Installation_Part_INSPIRE_ID"),
    )


def _older_sql(plants: str, ending: str, codes: dict[str, str], name: str, value: str) -> str:
    """Plant measures as rows of parts, missing ones left out; codes by measure."""
    rows = " UNION ALL ".join(
        f"SELECT part, ReferenceYear, '{code}', sum({measure}) FROM linked GROUP BY 1, 2"
        for measure, code in codes.items()
    )
    return f"""
    WITH linked AS (
        SELECT p.*, coalesce(
            'P' || CAST(ceil(s_suppkey / 2.0) AS BIGINT) || '{ending}', Unique_Plant_ID
        ) AS part
        FROM ({plants}) p LEFT JOIN supplier ON Unique_Plant_ID = 'C' || (s_suppkey * 2)
    ), melted(Installation_Part_INSPIRE_ID, reportingYear, {name}, {value}) AS ({rows})
    SELECT * FROM melted WHERE {value} IS NOT NULL
    """


_OLDER_EMISSIONS_SQL = _older_sql(
    _plants_sql("o_orderstatus", _PLANT_EMISSIONS, 0),
    "",
    {"NOx": "NOX", "SO2": "SO2", "Dust": "DUST"},
    "pollutantCode",
    "totalPollutantQuantityTNE",
)
_OLDER_FUELS_SQL = _older_sql(
    _plants_sql("o_orderpriority", _PLANT_FUELS, 20),
    "-0",
    {name: name for name in _PLANT_FUELS},
    "fuelInputCode",
    "energyInputTJ",
)


@query(
    "older_emissions_append",
    f"""
    SELECT Installation_Part_INSPIRE_ID, reportingYear, pollutantCode, totalPollutantQuantityTNE
    FROM ({_EMISSIONS_SQL})
    UNION
    SELECT Installation_Part_INSPIRE_ID, reportingYear, pollutantCode, totalPollutantQuantityTNE
    FROM ({_OLDER_EMISSIONS_SQL})
    """,
)
def older_emissions_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions of parts, with those of older plants under the parts they are linked to."""
    plants = _plants(spark, sf_dir, "o_orderstatus", _PLANT_EMISSIONS, 0)
    return fuels.append_older_emissions(
        _emissions(spark, sf_dir), plants, _part_links(spark, sf_dir, "")
    )


@query(
    "older_fuels_append",
    f"""
    WITH both_sources AS (
        SELECT Installation_Part_INSPIRE_ID, reportingYear, fuelInputCode, energyInputTJ
        FROM ({_SOLID_SQL})
        UNION
        SELECT Installation_Part_INSPIRE_ID, reportingYear, fuelInputCode, energyInputTJ
        FROM ({_OLDER_FUELS_SQL})
    ), solid AS (
        SELECT Installation_Part_INSPIRE_ID, max(fuelInputCode) AS solid FROM both_sources
        WHERE energyInputTJ > 0 AND reportingYear IN (2016, 2018)
          AND fuelInputCode IN ('Coal', 'Lignite', 'Peat')
        GROUP BY 1 HAVING count(DISTINCT fuelInputCode) = 1
    )
    SELECT Installation_Part_INSPIRE_ID, reportingYear, energyInputTJ,
           CASE WHEN fuelInputCode = 'OtherSolidFuels' THEN coalesce(solid, fuelInputCode)
                ELSE fuelInputCode END AS fuelInputCode
    FROM both_sources LEFT JOIN solid USING (Installation_Part_INSPIRE_ID)
    """,
)
def older_fuels_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of parts, with the fuel columns of older plants as rows, solid fuels told apart."""
    plants = _plants(spark, sf_dir, "o_orderpriority", _PLANT_FUELS, 20)
    return fuels.append_older_fuels(
        _solid_rows(spark, sf_dir), plants, _part_links(spark, sf_dir, "-0")
    )


# --- repaired emissions ---------------------------------------------------------------

_REPAIRED_EMISSIONS_SQL = repaired_units_sql(
    balanced_sql(_EMISSIONS_SQL, "reportingYear", _EMISSION_KEY, "totalPollutantQuantityTNE"),
    "totalPollutantQuantityTNE",
    _EMISSION_KEY,
    "reportingYear",
    UNIT_ERROR,
    0.5,
)


@query(
    "emissions_pipeline",
    f"""
    SELECT Installation_Part_INSPIRE_ID, pollutantCode, reportingYear,
           round(totalPollutantQuantityTNE, 6) AS totalPollutantQuantityTNE
    FROM ({_REPAIRED_EMISSIONS_SQL})
    """,
)
def emissions_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance, then repair unit errors."""
    cleaned = pipelines.emissions_to_air(_emissions(spark, sf_dir), balanced=True, repaired=True)
    return _rounded(cleaned, "totalPollutantQuantityTNE")


# A unit reports some years in the wrong unit for all fuels, others for one fuel only.
_WRONG_ENERGY_SQL = f"""
    SELECT * REPLACE (
        CASE WHEN (substr(Installation_Part_INSPIRE_ID, 2)::BIGINT * 7 + reportingYear) % 29 = 0
             THEN energyInputTJ * 1000
             WHEN (substr(Installation_Part_INSPIRE_ID, 2)::BIGINT * 5 + reportingYear) % 31 = 0
              AND fuelInputCode = 'NaturalGas' THEN energyInputTJ * 100000
             WHEN (substr(Installation_Part_INSPIRE_ID, 2)::BIGINT * 3 + reportingYear) % 37 = 0
              THEN 0.0
             ELSE energyInputTJ END AS energyInputTJ)
    FROM ({_ENERGY_ROWS_SQL})
"""


def _wrong_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.substr("Installation_Part_INSPIRE_ID", F.lit(2)).cast("long")
    year, v = F.col("reportingYear"), F.col("energyInputTJ")
    wrong = (
        F.when((unit * 7 + year) % 29 == 0, v * 1000)
        .when(
            ((unit * 5 + year) % 31 == 0) & (F.col("fuelInputCode") == "NaturalGas"), v * 100000
        )
        .when((unit * 3 + year) % 37 == 0, F.lit(0.0))
        .otherwise(v)
    )
    return _energy_rows(spark, sf_dir).withColumn("energyInputTJ", wrong)


_SERIES = [
    "Installation_Part_INSPIRE_ID",
    "fuelInputCode",
    "otherSolidFuelCode",
    "otherGaseousFuelCode",
]


def repaired_energy_sql(energy: str, emissions: str) -> str:
    unit = "Installation_Part_INSPIRE_ID"
    series = ", ".join(_SERIES)
    target = f"""SELECT {unit}, reportingYear, sum(energyInputTJ) AS target
        FROM e GROUP BY 1, 2"""
    jump_target = jumps_sql(
        "SELECT * FROM target", "target", [unit], "reportingYear", 0.75, 0.5, "s_t", "j_t"
    )
    jump_ratio = jumps_sql(
        "SELECT * FROM ratio", "ratio", [unit, "pollutantCode"], "reportingYear", 0.75, 0.5,
        "s_r", "j_r",
    )
    judged = outliers_sql(
        "SELECT * FROM ratio", "ratio", "target", [unit], ["pollutantCode"], "reportingYear",
        0.99, 2.0,
    )
    return f"""
        WITH e AS ({energy}),
        target AS ({target}),
        proxy AS (
            SELECT {unit}, reportingYear, pollutantCode, sum(totalPollutantQuantityTNE) AS proxy
            FROM ({emissions}) GROUP BY 1, 2, 3
        ),
        ratio AS (
            SELECT t.{unit}, t.reportingYear, p.pollutantCode, t.target, p.proxy,
                   CASE WHEN p.proxy > 0 THEN t.target / p.proxy END AS ratio
            FROM target t LEFT JOIN proxy p USING ({unit}, reportingYear)
        ),
        jumps AS (
            SELECT {unit}, reportingYear, max(s_r) AS jump
            FROM ({jump_target}) t JOIN ({jump_ratio}) r USING ({unit}, reportingYear)
            WHERE j_t AND j_r GROUP BY 1, 2
        ),
        offs AS (
            SELECT {unit}, reportingYear, nullif(round(median(ratio_to_median)), 0) AS off
            FROM ({judged}) GROUP BY 1, 2
        ),
        m AS (
            SELECT e.*, off, jump,
                   abs(CASE WHEN energyInputTJ > 0 AND lag(energyInputTJ) OVER w > 0
                            THEN log10(energyInputTJ / lag(energyInputTJ) OVER w) END) > 0.5
                       AS is_large,
                   median(energyInputTJ) FILTER (WHERE off IS NULL)
                       OVER (PARTITION BY {series}) AS mg,
                   median(energyInputTJ) FILTER (WHERE off IS NULL AND energyInputTJ > 0)
                       OVER (PARTITION BY {series} ORDER BY reportingYear
                             ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ml
            FROM e LEFT JOIN offs USING ({unit}, reportingYear)
            LEFT JOIN jumps USING ({unit}, reportingYear)
            WINDOW w AS (PARTITION BY {series} ORDER BY reportingYear)
        ),
        d AS (
            SELECT *, coalesce(ml, mg) AS med,
                   CASE WHEN off IS NOT NULL AND coalesce(ml, mg) > 0 AND energyInputTJ > 0
                        THEN round(log10(energyInputTJ / coalesce(ml, mg))) END AS dist
            FROM m
        )
        SELECT {series}, reportingYear,
               CASE
                   WHEN jump IS NOT NULL AND is_large
                    AND energyInputTJ / pow(10, jump) >= 0.1 * least(mg, ml)
                    AND energyInputTJ / pow(10, jump) <= 2.0 * greatest(mg, ml)
                   THEN energyInputTJ / pow(10, jump)
                   WHEN abs(dist) >= off AND dist <> 0
                    AND energyInputTJ / pow(10, dist) >= 0.1 * least(mg, ml)
                    AND energyInputTJ / pow(10, dist) <= 2.0 * greatest(mg, ml)
                   THEN energyInputTJ / pow(10, dist)
                   WHEN off IS NOT NULL AND med >= 100 AND energyInputTJ = 0 THEN NULL
                   ELSE energyInputTJ
               END AS energyInputTJ
        FROM d
    """


_ENERGY_PANEL_SQL = balanced_sql(
    standard_fuels_sql(_WRONG_ENERGY_SQL), "reportingYear", _SERIES, "energyInputTJ"
)


def _energy_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    standard = stage(fuels.standardise_fuels(_wrong_energy(spark, sf_dir)), "standard_fuels")
    return panel.balance(standard, "reportingYear", _SERIES)


@query(
    "proxy_repair_energy",
    f"""
    SELECT {", ".join(_SERIES)}, reportingYear, round(energyInputTJ, 6) AS energyInputTJ
    FROM ({repaired_energy_sql(_ENERGY_PANEL_SQL, _REPAIRED_EMISSIONS_SQL)})
    """,
)
def proxy_repair_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    emissions = pipelines.emissions_to_air(_emissions(spark, sf_dir), True, True)
    repaired = pipelines.energy_inputs(_wrong_energy(spark, sf_dir), emissions)
    return _rounded(repaired.select(*_SERIES, "reportingYear", "energyInputTJ"), "energyInputTJ")


@query(
    "energy_pipeline",
    _with_co2_sql(repaired_energy_sql(_ENERGY_PANEL_SQL, _REPAIRED_EMISSIONS_SQL)),
)
def energy_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardise fuels, balance, repair by emissions, estimate CO2."""
    emissions = pipelines.emissions_to_air(_emissions(spark, sf_dir), True, True)
    cleaned = pipelines.energy_inputs(
        _wrong_energy(spark, sf_dir), emissions, fuels.emission_factors(spark)
    )
    return _rounded_energy(cleaned)


@query(
    "energy_inferred_totals",
    f"""
    WITH e AS ({_ENERGY_PANEL_SQL}),
    target AS (
        SELECT Installation_Part_INSPIRE_ID, reportingYear, sum(energyInputTJ) AS target
        FROM e GROUP BY 1, 2
    ),
    ratio AS (
        SELECT Installation_Part_INSPIRE_ID, reportingYear, p.pollutantCode, t.target,
               p.totalPollutantQuantityTNE AS proxy,
               CASE WHEN p.totalPollutantQuantityTNE > 0
                    THEN t.target / p.totalPollutantQuantityTNE END AS ratio
        FROM target t LEFT JOIN ({_REPAIRED_EMISSIONS_SQL}) p
        USING (Installation_Part_INSPIRE_ID, reportingYear)
    ),
    kept AS (
        SELECT Installation_Part_INSPIRE_ID, reportingYear, pollutantCode, target, proxy,
               CASE WHEN is_outlier THEN NULL ELSE ratio END AS ratio
        FROM ({outliers_sql("SELECT * FROM ratio", "ratio", "target",
                            ["Installation_Part_INSPIRE_ID"], ["pollutantCode"],
                            "reportingYear", 0.99, 2.0)})
    ),
    edge AS (
        SELECT *, last_value(ratio IGNORE NULLS) OVER b AS r0,
               last_value(CASE WHEN ratio IS NOT NULL THEN reportingYear END IGNORE NULLS)
                   OVER b AS y0,
               first_value(ratio IGNORE NULLS) OVER a AS r1,
               first_value(CASE WHEN ratio IS NOT NULL THEN reportingYear END IGNORE NULLS)
                   OVER a AS y1
        FROM kept
        WINDOW b AS (PARTITION BY Installation_Part_INSPIRE_ID, pollutantCode
                     ORDER BY reportingYear ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               a AS (PARTITION BY Installation_Part_INSPIRE_ID, pollutantCode
                     ORDER BY reportingYear ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    )
    SELECT Installation_Part_INSPIRE_ID, reportingYear, max(target) AS total_actual,
           round(median(proxy * coalesce(ratio, r0 + (r1 - r0) * (reportingYear - y0)::DOUBLE
               / (y1 - y0)::DOUBLE)), 4) AS total_inferred
    FROM edge GROUP BY 1, 2
    """,
)
def energy_inferred_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual totals next to totals inferred from emissions and the bridged ratio."""
    emissions = pipelines.emissions_to_air(_emissions(spark, sf_dir), True, True)
    ratios = repair.energy_ratios(
        _energy_panel(spark, sf_dir),
        emissions,
        "Installation_Part_INSPIRE_ID",
        "reportingYear",
        "energyInputTJ",
        "totalPollutantQuantityTNE",
    )
    ratios = stage(ratios, "energy_ratios")
    inferred = repair.energy_inferred(ratios, "Installation_Part_INSPIRE_ID", "reportingYear")
    return inferred.withColumn("total_inferred", F.round("total_inferred", 4))


# --- audit ----------------------------------------------------------------------------

_AUDIT_KEY = ["Facility_INSPIRE_ID", "pollutantCode", "medium", "reportingYear"]


@query(
    "repair_audit",
    f"""
    WITH a AS ({_RELEASES_SQL}), b AS ({repaired_releases_sql(_RELEASES_SQL)})
    SELECT Facility_INSPIRE_ID, pollutantCode, medium, reportingYear,
           round(a.totalPollutantQuantityKg, 6) AS raw_value,
           round(b.totalPollutantQuantityKg, 6) AS repaired_value,
           coalesce(abs(a.totalPollutantQuantityKg - b.totalPollutantQuantityKg) > 1, FALSE)
               AS is_changed,
           a.totalPollutantQuantityKg IS NOT NULL AND b.totalPollutantQuantityKg IS NULL
               AS is_voided
    FROM a FULL JOIN b USING (Facility_INSPIRE_ID, pollutantCode, medium, reportingYear)
    """,
)
def repair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stage(_releases(spark, sf_dir), "releases")
    audit = repair.audit_repair(
        raw, repair.repair_releases(raw), _AUDIT_KEY, "totalPollutantQuantityKg"
    )
    return audit.withColumns({c: F.round(c, 6) for c in ("raw_value", "repaired_value")})


@query(
    "compare_totals",
    f"""
    SELECT pollutantCode, reportingYear, 'raw' AS source,
           round(sum(totalPollutantQuantityKg), 3) AS totalPollutantQuantityKg
    FROM ({_RELEASES_SQL}) GROUP BY 1, 2
    UNION ALL
    SELECT pollutantCode, reportingYear, 'repaired',
           round(sum(totalPollutantQuantityKg), 3)
    FROM ({repaired_releases_sql(_RELEASES_SQL)}) GROUP BY 1, 2
    """,
)
def compare_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stage(_releases(spark, sf_dir), "releases")
    totals = repair.compare_totals(
        raw,
        repair.repair_releases(raw),
        ["pollutantCode", "reportingYear"],
        "totalPollutantQuantityKg",
    )
    return totals.withColumn(
        "totalPollutantQuantityKg", F.round("totalPollutantQuantityKg", 3)
    )
