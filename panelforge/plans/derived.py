"""Panel-shaped tables derived from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def year_of(column: str) -> Column:
    return F.year(column).cast("long")


# Annual panel: supplier x return flag x year, quantity summed.
def annual_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("unit"),
            F.col("l_returnflag").alias("code"),
            year_of("l_shipdate").alias("yr"),
        )
        .agg(F.sum("l_quantity").alias("v"))
    )


ANNUAL_SQL = """
    SELECT l_suppkey AS unit, l_returnflag AS code, CAST(year(l_shipdate) AS BIGINT) AS yr,
           sum(l_quantity) AS v
    FROM lineitem GROUP BY 1, 2, 3
"""


# The same with unit errors: some cells a thousand times too large or too small.
def corrupt(value: Column, unit: Column, time: Column) -> Column:
    slot = (unit * 7 + time) % 41
    return F.when(slot == 0, value * 1000).when(slot == 5, value / 1000).otherwise(value)


def corrupted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual_panel(spark, sf_dir).withColumn(
        "v", corrupt(F.col("v"), F.col("unit"), F.col("yr"))
    )


CORRUPT_SQL = f"""
    SELECT unit, code, yr,
           CASE (unit * 7 + yr) % 41 WHEN 0 THEN v * 1000 WHEN 5 THEN v / 1000 ELSE v END AS v
    FROM ({ANNUAL_SQL})
"""


# Sparse daily panel: user x event type x day, value summed.
def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("unit"),
        F.col("event_type").alias("code"),
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
        .cast("long")
        .alias("day"),
        F.col("value").alias("v"),
    )


def daily_panel(rows: DataFrame) -> DataFrame:
    return rows.groupBy("unit", "code", "day").agg(F.round(F.sum("v"), 4).alias("v"))


DAILY_ROWS_SQL = """
    SELECT user_id AS unit, event_type AS code,
           CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day,
           value AS v
    FROM events
"""
DAILY_SQL = f"""
    SELECT unit, code, day, round(sum(v), 4) AS v FROM ({DAILY_ROWS_SQL}) GROUP BY 1, 2, 3
"""


def balanced_sql(panel: str, time: str, keys: list[str], value: str = "v") -> str:
    """Full grid of units and periods with the panel's values."""
    key_list = ", ".join(keys)
    same = " AND ".join(f"p.{k} IS NOT DISTINCT FROM u.{k}" for k in keys)
    units = ", ".join(f"u.{k}" for k in keys)
    return f"""
        SELECT {units}, t.{time}, p.{value}
        FROM (SELECT DISTINCT {key_list} FROM ({panel})) u
        CROSS JOIN (
            SELECT unnest(generate_series(lo, hi)) AS {time}
            FROM (SELECT min({time}) AS lo, max({time}) AS hi FROM ({panel}))
        ) t
        LEFT JOIN ({panel}) p ON {same} AND p.{time} = t.{time}
    """
