"""Fuel standardisation, older fuel categories and CO2 from emission factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.joins import melt, union_distinct_by_name
from panelforge.operators.panel import fill_missing
from panelforge.sources.staging import stage

UNIT = "Installation_Part_INSPIRE_ID"
TIME = "reportingYear"
ENERGY = "energyInputTJ"

# Words that name black liquor in the free-text details.
BLACK_LIQUOR_WORDS = ["black liquor", "licor negro", "lixívia negra", "ablauge"]

# Fuel of the 2006 factor table -> reported fuel code.
FACTOR_FUEL_TO_CODE = {
    "Crude Oil": "LiquidFuels",
    "Natural Gas Liquids": "LiquidFuels",
    "Motor Gasoline": "LiquidFuels",
    "Aviation Gasoline": "LiquidFuels",
    "Jet Gasoline": "LiquidFuels",
    "Jet Kerosene": "LiquidFuels",
    "Other Kerosene": "LiquidFuels",
    "Shale Oil": "LiquidFuels",
    "Gas/Diesel Oil": "LiquidFuels",
    "Residual Fuel Oil": "LiquidFuels",
    "Liquefied Petroleum Gases": "LPG",
    "Bitumen": "OtherSolidFuels",
    "Lubricants": "LiquidFuels",
    "Petroleum Coke": "Coke",
    "Refinery Feedstocks": "RefineryGas",
    "Blast Furnace Gas": "BlastFurnaceGas",
    "Oxygen Steel Furnace Gas": "OxygenSteel",
    "Coke Oven Gas": "CokeOvenGas",
    "Natural Gas": "NaturalGas",
    "Anthracite": "Coal",
    "Coking Coal": "Coal",
    "Other Bituminous Coal": "Coal",
    "Sub-Bituminous Coal": "Coal",
    "Lignite": "Lignite",
    "Oil Shale and Tar Sands": "Tar",
    "Brown Coal Briquettes": "Coal",
    "Coke Oven Coke and Lignite Coke": "Coke",
    "Gas Coke": "CokeOvenGas",
    "Coal Tar": "Tar",
    "Patent Fuel": "PatentFuels",
    "Peat": "Peat",
    "Wood/Wood Waste": "Biomass",
    "Sulphite lyes (Black Liquor)": "Biomass",
    "Municipal Wastes (biomass)": "Biomass",
    "Other Primary Solid Biomass": "Biomass",
    "Landfill Gas": "OtherGases",
    "Ethane": "OtherGases",
}

# Default CO2 factor per fuel, kg CO2 per TJ (2006 guidelines, table 2.2).
CO2_DEFAULT = {
    "Crude Oil": 73300.0,
    "Orimulsion": 77000.0,
    "Natural Gas Liquids": 64200.0,
    "Motor Gasoline": 69300.0,
    "Aviation Gasoline": 70000.0,
    "Jet Gasoline": 70000.0,
    "Jet Kerosene": 71500.0,
    "Other Kerosene": 71900.0,
    "Shale Oil": 73300.0,
    "Gas/Diesel Oil": 74100.0,
    "Residual Fuel Oil": 77400.0,
    "Liquefied Petroleum Gases": 63100.0,
    "Ethane": 61600.0,
    "Naphtha": 73300.0,
    "Bitumen": 80700.0,
    "Lubricants": 73300.0,
    "Petroleum Coke": 97500.0,
    "Refinery Feedstocks": 73300.0,
    "Natural Gas": 56100.0,
    "Anthracite": 98300.0,
    "Coking Coal": 94600.0,
    "Other Bituminous Coal": 94600.0,
    "Sub-Bituminous Coal": 96100.0,
    "Lignite": 101000.0,
    "Oil Shale and Tar Sands": 107000.0,
    "Brown Coal Briquettes": 97500.0,
    "Patent Fuel": 97500.0,
    "Coke Oven Coke and Lignite Coke": 107000.0,
    "Gas Coke": 107000.0,
    "Coal Tar": 80700.0,
    "Gas Works Gas": 44400.0,
    "Coke Oven Gas": 44400.0,
    "Blast Furnace Gas": 260000.0,
    "Oxygen Steel Furnace Gas": 182000.0,
    "Municipal Wastes (non-biomass)": 91700.0,
    "Industrial Wastes": 143000.0,
    "Waste Oils": 73300.0,
    "Peat": 106000.0,
    "Wood/Wood Waste": 112000.0,
    "Sulphite lyes (Black Liquor)": 95300.0,
    "Municipal Wastes (biomass)": 100000.0,
    "Other Primary Solid Biomass": 100000.0,
    "Landfill Gas": 54600.0,
    "Sludge Gas": 54600.0,
    "Other Biogas": 54600.0,
}


def standardise_fuels(df: DataFrame) -> DataFrame:
    """One row per unit, year and most specific fuel code.

    Details and sub-codes are borrowed from neighbouring years with actual use of the fuel.
    """
    used = F.col(ENERGY) > 0.0
    texts = ("furtherDetails", "otherSolidFuelCode", "otherGaseousFuelCode")
    # Rows that say the same are one from here on: they are borrowed for, coded and summed alike.
    # An aggregate in hash tables needs numbers as its values, so texts are its keys only.
    different = (
        df.select(
            UNIT, TIME, "fuelInputCode", *[F.when(used, F.col(c)).alias(c) for c in texts], ENERGY
        )
        .groupBy(UNIT, TIME, "fuelInputCode", *texts)
        .agg(F.sum(ENERGY).alias(ENERGY))
    )
    # Read for what neighbouring years lend and for the rows that borrow.
    different = stage(different, "fuel_rows")
    filled = fill_missing(different, {c: F.col(c) for c in texts}, [UNIT, "fuelInputCode"], TIME)
    details, gas = F.col("furtherDetails"), F.col("otherGaseousFuelCode")
    recoded_gas = (
        F.when(gas == "Other", F.lit(None))
        .when(gas == "FurnaceGas", F.lit("BlastFurnaceGas"))
        .when(details.rlike(f"(?iu)(?:{'|'.join(BLACK_LIQUOR_WORDS)})"), F.lit("Biomass"))
        .when(details.rlike("(?i)biogas"), F.lit("Biomass"))
        .otherwise(gas)
    )
    return (
        filled.withColumn("otherSolidFuelCode", F.nullif("otherSolidFuelCode", F.lit("Other")))
        .withColumn("otherGaseousFuelCode", recoded_gas)
        .withColumn(
            "fuelInputCode",
            F.coalesce("otherSolidFuelCode", "otherGaseousFuelCode", "fuelInputCode"),
        )
        .groupBy(UNIT, TIME, "fuelInputCode")
        .agg(
            F.max("otherSolidFuelCode").alias("otherSolidFuelCode"),
            F.max("otherGaseousFuelCode").alias("otherGaseousFuelCode"),
            F.sum(ENERGY).alias(ENERGY),
        )
    )


def append_older_fuels(
    df: DataFrame, plants: DataFrame, links: DataFrame, fuels: Sequence[str] | None = None
) -> DataFrame:
    """Append plant-level fuel columns of the older database as rows.

    Plants linked to a part take its identifier. The older catch-all for solid fuels is
    split where the part reports exactly one solid fuel afterwards.
    """
    fuels = list(
        fuels or ("Biomass", "OtherSolidFuels", "LiquidFuels", "NaturalGas", "OtherGases")
    )
    older = _plants_as_parts(plants, links, fuels, "fuelInputCode", ENERGY)
    return map_solid_fuels(union_distinct_by_name(df, older))


def append_older_emissions(df: DataFrame, plants: DataFrame, links: DataFrame) -> DataFrame:
    """Append plant-level emission columns of the older database as rows."""
    # Column of the older database -> pollutant code.
    codes = {"NOx": "NOX", "SO2": "SO2", "Dust": "DUST"}
    renamed = plants.select(
        "Unique_Plant_ID", "ReferenceYear", *[F.col(k).alias(v) for k, v in codes.items()]
    )
    older = _plants_as_parts(
        renamed, links, list(codes.values()), "pollutantCode", "totalPollutantQuantityTNE"
    )
    return union_distinct_by_name(df, older)


def _plants_as_parts(
    plants: DataFrame, links: DataFrame, measures: Sequence[str], name: str, value: str
) -> DataFrame:
    totals = (
        plants.select("Unique_Plant_ID", "ReferenceYear", *measures)
        .join(links.select("Unique_Plant_ID", UNIT), "Unique_Plant_ID", "left")
        .groupBy(
            F.coalesce(UNIT, "Unique_Plant_ID").alias(UNIT), F.col("ReferenceYear").alias(TIME)
        )
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    return melt(totals, [UNIT, TIME], measures, name, value)


def map_solid_fuels(df: DataFrame) -> DataFrame:
    """Older catch-all solid fuel takes the unit's only solid fuel of 2016 or 2018, if unique."""
    unique = (
        df.where(
            (F.col(ENERGY) > 0.0)
            & F.col(TIME).isin(2016, 2018)
            & F.col("fuelInputCode").isin("Coal", "Lignite", "Peat")
        )
        .groupBy(UNIT)
        .agg(
            F.min("fuelInputCode").alias("_first"),
            F.max("fuelInputCode").alias("_solid"),
        )
        .where(F.col("_first") == F.col("_solid"))
        .select(UNIT, F.lit("OtherSolidFuels").alias("fuelInputCode"), "_solid")
    )
    return (
        df.join(unique, [UNIT, "fuelInputCode"], "left")
        .withColumn("fuelInputCode", F.coalesce("_solid", "fuelInputCode"))
        .select(*df.columns)
    )


def default_factors(spark: SparkSession) -> DataFrame:
    """The default CO2 factors as a table."""
    return spark.createDataFrame(list(CO2_DEFAULT.items()), "Fuel string, CO2_Default double")


def emission_factors(spark: SparkSession, factors: DataFrame | None = None) -> DataFrame:
    """Mean factor per reported fuel code in tonnes CO2 per TJ."""
    factors = default_factors(spark) if factors is None else factors
    mapping = spark.createDataFrame(
        list(FACTOR_FUEL_TO_CODE.items()), "Fuel string, fuelInputCode string"
    )
    # The mapping is a constant of this module, so its size is known.
    return (
        factors.join(F.broadcast(mapping), "Fuel", "inner")
        .groupBy("fuelInputCode")
        .agg((F.avg("CO2_Default") / 1000.0).alias("emission_factor_tCO2TJ"))
    )


def estimate_co2(df: DataFrame, factors: DataFrame) -> DataFrame:
    """Energy times the factor of its fuel; unmapped fuels stay missing."""
    return df.join(factors, "fuelInputCode", "left").select(
        *df.columns,
        "emission_factor_tCO2TJ",
        (F.col(ENERGY) * F.col("emission_factor_tCO2TJ")).alias("tCO2"),
    )
