"""Dataset catalogue: name, schema, text conventions and location of every table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelforge.constants import DATASET_VERSIONS, LATEST_VERSION, NA_VALUES
from panelforge.sources.csv_source import cast_text, read_typed_csv
from panelforge.sources.plant_tables import PLANT_TABLES
from panelforge.sources.register_tables import REGISTER_TABLES
from panelforge.sources.reporting_tables import REPORTING_TABLES

METADATA_TABLE = "0a_DataCollectionMetadata_EUReg"

# Columns of the small crosswalk and lookup files.
CROSSWALKS = {
    "deduplication_facility": "Facility_INSPIRE_ID_cluster string, Facility_INSPIRE_ID string",
    "deduplication_lcpmapping": "Facility_INSPIRE_ID_cluster string, Facility_INSPIRE_ID string",
    "links_lcp_facility": """Unique_Plant_ID string, Facility_INSPIRE_ID string,
        match_weight double, match_probability double""",
    "links_lcp_part": """Unique_Plant_ID string, Installation_Part_INSPIRE_ID string,
        match_weight double, match_probability double""",
    "links-eprtr": """Facility_INSPIRE_ID string, FacilityID int,
        match_weight double, match_probability double""",
    "ipcc2006_table_2_2": """Fuel string, CO2_Default double, CO2_Lower double,
        CO2_Upper double, CH4_Default double, CH4_Lower double, CH4_Upper double,
        N2O_Default double, N2O_Lower double, N2O_Upper double""",
    "legal_forms": """`Entity Legal Form name Local name` string,
        `Entity Legal Form name Transliterated name (per ISO 01-140-10)` string,
        `Abbreviations Local language` string, `Abbreviations transliterated` string""",
}


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def table_schema(name: str) -> T.StructType:
    for tables in (REPORTING_TABLES, REGISTER_TABLES, PLANT_TABLES):
        if name in tables:
            return schema_of(tables[name])
    raise KeyError(f"Unknown table: {name}")


@dataclass(frozen=True)
class Catalog:
    """Where the files are; every reader returns a lazy DataFrame.

    ``root`` holds ``reporting/<version folder>/``, ``register/``, ``plants/`` and
    ``crosswalks/``. ``as_of`` (a date) settles two-digit years.
    """

    spark: SparkSession
    root: str
    as_of: str | None = None
    reload: bool = False

    def reporting(self, table: str, version: str = LATEST_VERSION) -> DataFrame:
        folder = DATASET_VERSIONS.get(version, version)
        return self._read(f"reporting/{folder}/{table}.csv", REPORTING_TABLES[table], table)

    def register(self, table: str) -> DataFrame:
        return self._read(f"register/{table}.csv", REGISTER_TABLES[table], table)

    def plants(self, table: str) -> DataFrame:
        return self._read(f"plants/{table}.csv", PLANT_TABLES[table], table)

    def crosswalk(self, name: str) -> DataFrame:
        """Small lookup file: declared columns by name, no copy is kept."""
        raw = self.spark.read.csv(f"{self.root}/crosswalks/{name}.csv", header=True)
        return raw.select(
            *[cast_text(f.name, f.dataType) for f in schema_of(CROSSWALKS[name])]
        )

    def loader(self, table: str):
        """A ``(spark, version) -> DataFrame`` callable for version stacking."""
        return lambda _spark, version: self.reporting(table, version)

    def _read(self, path: str, ddl: str, table: str) -> DataFrame:
        return read_typed_csv(
            self.spark,
            f"{self.root}/{path}",
            schema_of(ddl),
            na_values=None if table == METADATA_TABLE else NA_VALUES,
            as_of=self.as_of,
            reload=self.reload,
        )
