"""Queries: every typed table of the three databases, written as CSV text and read back.

One row per customer and table. Cells follow from the customer's number and the column's place, by
the column's declared type, with sentinels, bad values, fractions, separators, quotes, line breaks
and short dates among them. A query reads a database through the catalogue and gives, for each
column and for whole rows, how many values are known and a checksum of them.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.constants import DATASET_VERSIONS, LATEST_VERSION
from panelforge.plans.derived import table
from panelforge.plans.registry import query
from panelforge.sources.catalog import METADATA_TABLE, Catalog
from panelforge.sources.plant_tables import PLANT_TABLES
from panelforge.sources.register_tables import REGISTER_TABLES
from panelforge.sources.reporting_tables import REPORTING_TABLES
from panelforge.sources.staging import stage_path

#: Two-digit years from 26 on belong to the last century.
_AS_OF = "2026-01-01"
_LATE = 26


def _columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a table's columns, without a session."""
    pairs = [column.strip().rsplit(" ", 1) for column in ddl.split(",")]
    return [(name.strip("`"), kind) for name, kind in pairs]


def _parts(at: int) -> dict[str, str]:
    """SQL pieces, the same in both engines, that a cell of this place is made of."""
    k = "c_custkey"
    return {
        "slot": f"({k} * 7 + {at}) % 17",
        "whole": f"(({k} * 31 + {at}) % 100000)",
        "part": f"(({k} * 13 + {at}) % 10000)",
        "word": f"concat('c{at}-', {k} % 97)",
        "odd": f"concat('c{at}, \"', {k} % 97, '\"', chr(10), 'end')",
        "day": f"concat(lpad(CAST({k} % 12 + 1 AS {{text}}), 2, '0'), '{{gap}}', "
        f"lpad(CAST(({k} + {at}) % 28 + 1 AS {{text}}), 2, '0'))",
        "year": f"(({k} * 3 + {at}) % 100)",
        "flag": f"CASE WHEN ({k} + {at}) % 2 = 0 THEN 'true' ELSE 'false' END",
    }


def _written(kind: str, at: int) -> Column:
    """The cell as CSV text."""
    p = _parts(at)
    special = "WHEN 0 THEN 'CONFIDENTIAL' WHEN 1 THEN 'about 5'"
    if kind == "int":
        special += f" WHEN 2 THEN concat({p['whole']}, '.5')"
        plain = f"CAST({p['whole']} AS string)"
    elif kind == "double":
        plain = f"concat({p['part']}, '.25')"
    elif kind == "boolean":
        plain = p["flag"]
    elif kind == "timestamp_ntz":
        day = p["day"].format(text="string", gap="/")
        plain = f"concat({day}, '/', lpad(CAST({p['year']} AS string), 2, '0'), ' 10:20:30')"
    else:
        special += f" WHEN 3 THEN {p['odd']}"
        plain = p["word"]
    return F.expr(f"CASE {p['slot']} {special} ELSE {plain} END")


def _expected_sql(kind: str, at: int, sentinels: bool) -> str:
    """The typed cell as text, in SQL."""
    p = _parts(at)
    null = "WHEN 0 THEN NULL WHEN 1 THEN NULL"
    if kind == "int":
        return f"CASE {p['slot']} {null} WHEN 2 THEN CAST({p['whole']} + 1 AS VARCHAR) ELSE CAST({p['whole']} AS VARCHAR) END"
    if kind == "double":
        return f"CASE {p['slot']} {null} ELSE CAST(4 * {p['part']} + 1 AS VARCHAR) END"
    if kind == "boolean":
        return f"CASE {p['slot']} {null} ELSE {p['flag']} END"
    if kind == "timestamp_ntz":
        century = f"CASE WHEN {p['year']} < {_LATE} THEN '20' ELSE '19' END"
        day = p["day"].format(text="VARCHAR", gap="-")
        year = f"concat({century}, lpad(CAST({p['year']} AS VARCHAR), 2, '0'))"
        return f"CASE {p['slot']} {null} ELSE concat({year}, '-', {day}, ' 10:20:30') END"
    first = "NULL" if sentinels else "'CONFIDENTIAL'"
    return f"CASE {p['slot']} WHEN 0 THEN {first} WHEN 1 THEN 'about 5' WHEN 3 THEN {p['odd']} ELSE {p['word']} END"


def _read(name: str, kind: str) -> Column:
    """The typed cell as text, from what the catalogue has read."""
    value = F.col(f"`{name}`")
    if kind == "double":
        value = F.round(value * 4).cast("long")
    elif kind == "timestamp_ntz":
        value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return value.cast("string")


def _checked(typed: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, known, checksum) of a table's columns and of its whole rows."""
    texts = {f.name: _read(f.name, f.dataType.simpleString()) for f in typed.schema}
    row = F.concat_ws("|", *[F.coalesce(t, F.lit("~")) for t in texts.values()])
    sums = []
    for column, text in {**texts, "(row)": row}.items():
        number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
        sums.append(
            F.struct(F.lit(column).alias("column_name"), F.count(text).alias("known"),
                     F.coalesce(F.sum(number), F.lit(0)).alias("checksum"))
        )
    return typed.agg(F.array(*sums).alias("c")).select(
        F.lit(name).alias("table_name"), F.inline("c")
    )


def _expected(tables: dict[str, str]) -> str:
    """The same numbers from the expected cells."""
    ctes, selects = [], []
    for name, ddl in tables.items():
        columns = _columns(ddl)
        cells = [
            _expected_sql(kind, at, name != METADATA_TABLE) for at, (_, kind) in enumerate(columns)
        ]
        inner = ", ".join(f"{sql} AS x{at}" for at, sql in enumerate(cells))
        row = ", ".join(f"coalesce(x{at}, '~')" for at in range(len(cells)))
        ctes.append(f"""
    "cells {name}" AS MATERIALIZED (
        SELECT *, concat_ws('|', {row}) AS whole FROM (SELECT {inner} FROM customer))""")
        texts = [(column, f"x{at}") for at, (column, _) in enumerate(columns)]
        for column, text in [*texts, ("(row)", "whole")]:
            selects.append(f"""
    SELECT '{name}' AS table_name, '{column}' AS column_name, count({text}) AS known,
           coalesce(sum(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)), 0)::BIGINT AS checksum
    FROM "cells {name}" """)
    return f"WITH {','.join(ctes)} " + " UNION ALL ".join(selects)


def _database(spark: SparkSession, sf_dir: str, tables: dict[str, str], folder: str, read):
    # A key makes many cells: the size of the keys' file may not set the number of writers.
    tasks = spark.sparkContext.defaultParallelism
    customers = table(spark, sf_dir, "customer").select("c_custkey").repartition(tasks)
    root = stage_path(spark, "catalogue")
    catalog = Catalog(spark, root, as_of=_AS_OF)

    def checked(item: tuple[str, str]) -> DataFrame:
        name, ddl = item
        cells = [_written(kind, at).alias(c) for at, (c, kind) in enumerate(_columns(ddl))]
        written = customers.select(*cells, F.lit("left out").alias("notDeclared"))
        written.write.csv(f"{root}/{folder}/{name}.csv", header=True, escape='"')
        return _checked(read(catalog, name), name)

    with ThreadPoolExecutor(4) as pool:  # the tables' small jobs run side by side
        return reduce(DataFrame.unionByName, pool.map(checked, tables.items()))


@query("reporting_tables", _expected(REPORTING_TABLES))
def reporting_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty tables of the industrial reporting database."""
    folder = f"reporting/{DATASET_VERSIONS[LATEST_VERSION]}"
    return _database(spark, sf_dir, REPORTING_TABLES, folder, Catalog.reporting)


@query("register_tables", _expected(REGISTER_TABLES))
def register_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the older pollutant register."""
    return _database(spark, sf_dir, REGISTER_TABLES, "register", Catalog.register)


@query("plant_tables", _expected(PLANT_TABLES))
def plant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the older combustion plant database."""
    return _database(spark, sf_dir, PLANT_TABLES, "plants", Catalog.plants)
