"""Queries: versions, crosswalks, hierarchy, registers, files and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.constants import DATE_FORMAT, NA_VALUES
from panelforge.datasets import tables
from panelforge.functions import text as names
from panelforge.linkage.blocking import block_on, candidate_pairs
from panelforge.operators import crosswalk, hierarchy, versions
from panelforge.operators.joins import rows_not_listed, union_distinct_by_name
from panelforge.operators.numbering import with_dense_ids
from panelforge.operators.panel import fill_from_latest
from panelforge.plans.derived import table, year_of
from panelforge.plans.registry import query
from panelforge.sources import csv_source, sinks
from panelforge.sources.staging import NamedStages, stage_path


def _text_id(prefix: str, column: str | Column) -> Column:
    key = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(prefix), key.cast("string"))


# --- versions: orders belong to one of three pseudo-versions ---------------------------

_VERSIONS = ["v1", "v2", "v3"]
_VERSIONED_SQL = """
    SELECT o_custkey AS Facility_INSPIRE_ID, CAST(year(o_orderdate) * 10
               + substr(o_orderpriority, 1, 1)::INTEGER AS INTEGER) AS fileId_EUReg,
           o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price,
           'v' || (o_orderkey % 3 + 1) AS version, CAST(o_orderkey % 3 AS INTEGER)
               AS version_ordinal
    FROM orders
"""
_METADATA_SQL = """
    SELECT 'v' || (o_orderkey % 3 + 1) AS version, CAST(year(o_orderdate) * 10
               + substr(o_orderpriority, 1, 1)::INTEGER AS INTEGER) AS fileId,
           max(o_orderdate) AS dateSubmitted, CAST(year(min(o_orderdate)) AS INTEGER)
               AS reportingYear
    FROM orders GROUP BY 1, 2
"""


def _file_id() -> Column:
    digit = F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("int")
    return F.year("o_orderdate") * 10 + digit


def _version_loader(sf_dir: str):
    def load(spark: SparkSession, version: str) -> DataFrame:
        wanted = F.col("o_orderkey") % 3 == _VERSIONS.index(version)
        return (
            table(spark, sf_dir, "orders")
            .where(wanted)
            .select(
                F.col("o_custkey").alias("Facility_INSPIRE_ID"),
                _file_id().alias("fileId_EUReg"),
                F.col("o_orderstatus").alias("status"),
                F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
            )
        )

    return load


def _metadata_loader(sf_dir: str):
    def load(spark: SparkSession, version: str) -> DataFrame:
        wanted = F.col("o_orderkey") % 3 == _VERSIONS.index(version)
        return (
            table(spark, sf_dir, "orders")
            .where(wanted)
            .groupBy(_file_id().alias("fileId"))
            .agg(
                F.max("o_orderdate").alias("dateSubmitted"),
                F.year(F.min("o_orderdate")).alias("reportingYear"),
            )
        )

    return load


@query("versions_scan", _VERSIONED_SQL)
def versions_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.stack(spark, _version_loader(sf_dir), _VERSIONS)


@query(
    "versions_metadata",
    f"""
    SELECT s.*, m.dateSubmitted, m.reportingYear
    FROM ({_VERSIONED_SQL}) s LEFT JOIN ({_METADATA_SQL}) m
    ON m.fileId = s.fileId_EUReg AND m.version = s.version
    """,
)
def versions_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.add_metadata(
        versions.stack(spark, _version_loader(sf_dir), _VERSIONS),
        versions.stack(spark, _metadata_loader(sf_dir), _VERSIONS),
    )


_LATEST_SQL = f"""
    SELECT reportingYear, Facility_INSPIRE_ID, status, price
    FROM ({_VERSIONED_SQL}) s LEFT JOIN ({_METADATA_SQL}) m
    ON m.fileId = s.fileId_EUReg AND m.version = s.version
    QUALIFY row_number() OVER (
        PARTITION BY reportingYear, Facility_INSPIRE_ID
        ORDER BY dateSubmitted DESC NULLS FIRST, version_ordinal DESC, fileId_EUReg DESC,
                 status DESC, price DESC NULLS LAST) = 1
"""


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.stack_versions(
        spark,
        _version_loader(sf_dir),
        _metadata_loader(sf_dir),
        ["reportingYear", "Facility_INSPIRE_ID"],
        _VERSIONS,
    )


@query("stack_versions_latest", _LATEST_SQL)
def stack_versions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked(spark, sf_dir)


# Customers appear in an older register with their own ids and a year per report.
_OLDER_SQL = """
    SELECT CAST(c_custkey AS INTEGER) AS FacilityID, CAST(1990 + c_custkey % 12 AS INTEGER)
               AS ReportingYear, c_mktsegment AS ParentCompanyName, c_name AS FacilityName
    FROM customer
"""
_LINKS_SQL = """
    SELECT CAST(c_custkey AS INTEGER) AS FacilityID, c_custkey AS Facility_INSPIRE_ID,
           c_acctbal AS match_weight
    FROM customer WHERE c_custkey % 4 <> 3
    UNION ALL
    SELECT CAST(c_custkey AS INTEGER), c_custkey - c_custkey % 10, 5000.0 FROM customer
"""


@query(
    "facility_master",
    f"""
    WITH stacked AS ({_LATEST_SQL}),
    linked AS (
        SELECT FacilityID, Facility_INSPIRE_ID FROM ({_LINKS_SQL})
        QUALIFY row_number() OVER (
            PARTITION BY FacilityID ORDER BY match_weight DESC, Facility_INSPIRE_ID) = 1
    ),
    mapped AS (
        SELECT Facility_INSPIRE_ID, ReportingYear AS reportingYear,
               ParentCompanyName AS parentCompanyName, FacilityName AS nameOfFeature
        FROM ({_OLDER_SQL}) JOIN linked USING (FacilityID)
    ),
    combined AS (
        SELECT * FROM stacked
        UNION BY NAME
        SELECT * FROM mapped WHERE (Facility_INSPIRE_ID, reportingYear) NOT IN (
            SELECT (Facility_INSPIRE_ID, reportingYear) FROM stacked)
    ),
    filled AS (
        SELECT Facility_INSPIRE_ID, reportingYear,
               coalesce(status, first_value(status IGNORE NULLS) OVER (
                   w ORDER BY reportingYear DESC, status DESC NULLS LAST)) AS status,
               coalesce(price, first_value(price IGNORE NULLS) OVER (
                   w ORDER BY reportingYear DESC, price DESC NULLS LAST)) AS price,
               coalesce(parentCompanyName, first_value(parentCompanyName IGNORE NULLS) OVER (
                   w ORDER BY reportingYear DESC, parentCompanyName DESC NULLS LAST))
                   AS parentCompanyName,
               coalesce(nameOfFeature, first_value(nameOfFeature IGNORE NULLS) OVER (
                   w ORDER BY reportingYear DESC, nameOfFeature DESC NULLS LAST))
                   AS nameOfFeature
        FROM combined WINDOW w AS (PARTITION BY Facility_INSPIRE_ID)
    )
    SELECT CASE WHEN Facility_INSPIRE_ID % 9 = 1 THEN Facility_INSPIRE_ID - 1
                ELSE Facility_INSPIRE_ID END AS Facility_INSPIRE_ID,
           reportingYear, status, price, parentCompanyName, nameOfFeature
    FROM filled
    """,
)
def facility_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions, years only the older register has, attributes filled, clusters merged."""
    customers = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    older = customers.select(
        key.cast("int").alias("FacilityID"),
        (1990 + key % 12).cast("int").alias("ReportingYear"),
        F.col("c_mktsegment").alias("ParentCompanyName"),
        F.col("c_name").alias("FacilityName"),
    )
    links = customers.where(key % 4 != 3).select(
        key.cast("int").alias("FacilityID"),
        key.alias("Facility_INSPIRE_ID"),
        F.col("c_acctbal").alias("match_weight"),
    )
    links = links.union(
        customers.select(key.cast("int"), key - key % 10, F.lit(5000.0))
    )
    clusters = customers.where(key % 9 == 1).select(
        (key - 1).alias("Facility_INSPIRE_ID_cluster"), key.alias("Facility_INSPIRE_ID")
    )
    return tables.facility_master(_stacked(spark, sf_dir), older, links, clusters)


@query(
    "missing_keys_append",
    """
    WITH late AS (
        SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS yr, max(o_totalprice) AS price
        FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2
    ),
    early AS (
        SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS yr, max(o_orderpriority) AS note
        FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2
    ),
    combined AS (
        SELECT * FROM late UNION BY NAME
        SELECT * FROM early WHERE (o_custkey, yr) NOT IN (SELECT (o_custkey, yr) FROM late)
    )
    SELECT o_custkey, yr,
           coalesce(price, first_value(price IGNORE NULLS) OVER w) AS price,
           coalesce(note, first_value(note IGNORE NULLS) OVER w) AS note
    FROM combined WINDOW w AS (PARTITION BY o_custkey ORDER BY yr DESC)
    """,
)
def missing_keys_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    keys = ["o_custkey", year_of("o_orderdate").alias("yr")]
    late = orders.where("o_orderstatus <> 'F'").groupBy(*keys)
    late = late.agg(F.max("o_totalprice").alias("price"))
    early = orders.where("o_orderstatus = 'F'").groupBy(*keys)
    early = early.agg(F.max("o_orderpriority").alias("note"))
    missing = rows_not_listed(early, late, "o_custkey", "yr")
    combined = union_distinct_by_name(late, missing)
    return fill_from_latest(combined, ["price", "note"], ["o_custkey"], "yr")


@query(
    "part_master",
    """
    WITH own AS (
        SELECT 'S' || l_suppkey AS Installation_Part_INSPIRE_ID,
               CAST(year(l_shipdate) AS INTEGER) AS reportingYear,
               max(l_quantity) AS totalRatedThermalInput
        FROM lineitem GROUP BY 1, 2
    ),
    older AS (
        SELECT 'S' || (o_custkey % 50) AS Installation_Part_INSPIRE_ID,
               CAST(year(o_orderdate) AS INTEGER) AS reportingYear,
               CAST(count(*) AS DOUBLE) AS totalRatedThermalInput,
               CAST(max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS INTEGER)
                   AS withinRefinery,
               bool_or(o_orderpriority = '1-URGENT') AS optOutPlant
        FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1, 2
    )
    SELECT Installation_Part_INSPIRE_ID, reportingYear, totalRatedThermalInput, withinRefinery,
           coalesce(optOutPlant, FALSE) AS optOutPlant
    FROM (SELECT * FROM own UNION BY NAME SELECT * FROM older)
    """,
)
def part_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own parts plus totals of linked older plants."""
    stacked = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            _text_id("S", "l_suppkey").alias("Installation_Part_INSPIRE_ID"),
            F.year("l_shipdate").alias("reportingYear"),
        )
        .agg(F.max("l_quantity").alias("totalRatedThermalInput"))
    )
    plants = table(spark, sf_dir, "orders").select(
        _text_id("C", "o_custkey").alias("Unique_Plant_ID"),
        F.year("o_orderdate").alias("ReferenceYear"),
        F.lit(1.0).alias("MWth"),
        (F.col("o_orderstatus") == "P").alias("Refineries"),
        (F.col("o_orderpriority") == "1-URGENT").alias("OptOutPlant"),
    )
    key = F.col("c_custkey")
    links = (
        table(spark, sf_dir, "customer")
        .where(key % 3 == 0)
        .select(
            _text_id("C", key).alias("Unique_Plant_ID"),
            _text_id("S", key % 50).alias("Installation_Part_INSPIRE_ID"),
        )
    )
    return tables.part_master(stacked, plants, links)


@query(
    "plant_master",
    """
    SELECT o_custkey AS FK_BasicData_ID, CAST(year(o_orderdate) AS INTEGER) AS ReferenceYear,
           o_orderkey AS FK_Plant_ID, o_orderpriority AS PlantName, l_quantity AS MWth,
           l_linenumber AS Line, l_tax AS SO2
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
    """,
)
def plant_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver, plants and detail tables in one star join; shared columns are kept once."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    basic = orders.select(
        F.col("o_orderkey").alias("ID"), F.year("o_orderdate").alias("ReferenceYear")
    )
    plants = orders.select(
        F.col("o_orderkey").alias("FK_BasicData_ID"),
        F.col("o_orderkey").alias("ID"),
        F.col("o_custkey").alias("Customer"),
        F.col("o_orderpriority").alias("PlantName"),
    )
    details = lines.select(
        F.col("l_orderkey").alias("FK_Plant_ID"),
        F.lit("again").alias("PlantName"),
        F.col("l_quantity").alias("MWth"),
        F.col("l_linenumber").alias("Line"),
        F.col("l_tax").alias("SO2"),
    )
    return (
        tables.plant_master(basic, plants, details)
        .drop("FK_BasicData_ID")
        .withColumnRenamed("Customer", "FK_BasicData_ID")
    )


@query(
    "register_releases",
    """
    SELECT l_orderkey AS FacilityReportID, l_linenumber AS Line, l_quantity AS TotalQuantity,
           o_custkey AS FacilityID, c_nationkey AS PollutantReleaseAndTransferReportID,
           n_regionkey AS ReportingYear
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
    LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
    """,
)
def register_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases with facility and year: orders play facility reports, nations reports."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey"
    )
    facility_reports = (
        table(spark, sf_dir, "orders")
        .join(customers, "o_custkey")
        .select(
            F.col("o_custkey").alias("FacilityID"),
            F.col("o_orderkey").alias("FacilityReportID"),
            F.col("c_nationkey").alias("PollutantReleaseAndTransferReportID"),
        )
    )
    reports = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("PollutantReleaseAndTransferReportID"),
        F.col("n_regionkey").alias("ReportingYear"),
    )
    releases = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("FacilityReportID"),
        F.col("l_linenumber").alias("Line"),
        F.col("l_quantity").alias("TotalQuantity"),
    )
    return tables.register_releases(releases, facility_reports, reports)


@query(
    "register_facilities",
    """
    SELECT c_nationkey AS CountryCode, c_custkey AS FacilityReportID, c_name AS FacilityName,
           CAST(year(o_orderdate) AS INTEGER) AS ReportingYear
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
    """,
)
def register_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility reports with the years of their changes."""
    reports = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("CountryCode"),
        F.col("c_custkey").alias("FacilityReportID"),
        F.col("c_name").alias("FacilityName"),
    )
    changes = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == "P")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_nationkey").alias("CountryCode"),
            F.col("c_custkey").alias("FacilityReportID"),
            F.year("o_orderdate").alias("ReportingYear"),
        )
    )
    return tables.register_facilities(reports, changes)


# --- crosswalks -----------------------------------------------------------------------

_CUSTOMER_CLUSTERS_SQL = """
    SELECT c_custkey AS id, c_custkey - c_custkey % 5 AS id_cluster
    FROM customer WHERE c_custkey % 5 IN (1, 2)
"""


def _customer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .where((key % 5).isin(1, 2))
        .select(key.alias("id"), (key - key % 5).alias("id_cluster"))
    )


@query(
    "crosswalk_apply",
    f"""
    SELECT coalesce(id_cluster, o_custkey) AS id, o_orderkey
    FROM orders LEFT JOIN ({_CUSTOMER_CLUSTERS_SQL}) ON id = o_custkey
    """,
)
def crosswalk_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return crosswalk.apply_crosswalk(orders, _customer_clusters(spark, sf_dir), "id")


# Orders of one customer as candidate partners: the price plays the weight.
@query(
    "best_match",
    """
    SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders
    QUALIFY row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1
    """,
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice"
    )
    return crosswalk.best_match(pairs, "o_custkey", "o_totalprice", ["o_orderkey"])


@query(
    "best_by_weight",
    """
    SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey,
           arg_max(o_orderstatus, o_totalprice) AS o_orderstatus
    FROM orders GROUP BY 1
    """,
)
def best_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosswalk.best_by_weight(
        table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", ["o_orderstatus"]
    )


_CHAIN_SQL = """
    SELECT c_custkey AS member, CASE WHEN c_custkey % 7 = 3 THEN c_custkey - 3
        WHEN c_custkey % 7 = 0 THEN c_custkey + 1 END AS cluster
    FROM customer WHERE c_custkey % 7 IN (0, 3)
"""


@query(
    "one_to_one",
    f"""
    SELECT member, cluster FROM ({_CHAIN_SQL})
    WHERE member NOT IN (SELECT cluster FROM ({_CHAIN_SQL}))
    """,
)
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    matches = (
        table(spark, sf_dir, "customer")
        .where((key % 7).isin(0, 3))
        .select(
            key.alias("member"),
            F.when(key % 7 == 3, key - 3).otherwise(key + 1).alias("cluster"),
        )
    )
    return crosswalk.enforce_one_to_one(matches, "member", "cluster")


@query(
    "edges_to_unlinked",
    """
    WITH pair AS (
        SELECT a.o_orderkey AS id_l, b.o_orderkey AS id_r,
               CASE WHEN a.o_orderstatus <> 'P' THEN a.o_custkey END AS known_l,
               CASE WHEN b.o_orderstatus <> 'P' THEN b.o_custkey END AS known_r,
               abs(a.o_totalprice - b.o_totalprice) AS weight
        FROM orders a JOIN orders b
          ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
         AND a.o_orderkey < b.o_orderkey
    )
    SELECT id, known, weight FROM (
        SELECT CASE WHEN known_l IS NULL THEN id_l ELSE id_r END AS id,
               coalesce(known_l, known_r) AS known, weight
        FROM pair WHERE (known_l IS NULL) <> (known_r IS NULL)
    ) QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, known) = 1
    """,
)
def edges_to_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderpriority",
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("known"),
        F.col("o_totalprice").alias("price"),
    )
    pairs = candidate_pairs(orders, None, "id", [block_on("o_custkey", "o_orderpriority")])
    weighted = pairs.withColumn("weight", F.abs(F.col("price_l") - F.col("price_r")))
    return crosswalk.edges_to_unlinked(weighted, "id", "known", "weight")


@query(
    "crosswalk_duplicates",
    """
    SELECT c_name AS id, count(*) AS occurrences FROM (
        SELECT c_name FROM customer UNION ALL
        SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey
        WHERE o_orderstatus = 'P'
    ) GROUP BY 1 HAVING count(*) > 1
    """,
)
def crosswalk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    pending = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    again = pending.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    listed = customers.select(F.col("c_name").alias("id")).union(again.select("c_name"))
    return crosswalk.duplicate_identifiers(listed, "id")


@query(
    "crosswalk_missing_pairs",
    """
    SELECT DISTINCT o_custkey AS id, o_orderpriority AS note FROM orders WHERE o_orderstatus = 'F'
    AND NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_custkey = orders.o_custkey
                    AND k.o_orderpriority = orders.o_orderpriority AND k.o_orderstatus = 'O')
    """,
)
def crosswalk_missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("note"), "o_orderstatus"
    )
    expected = orders.where("o_orderstatus = 'F'").select("id", "note").distinct()
    return crosswalk.missing_pairs(orders.where("o_orderstatus = 'O'"), expected)


@query(
    "unmapped_report",
    """
    SELECT c_custkey AS id, o_orderpriority,
           round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100, 2) AS total
    FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE c_custkey % 5 NOT IN (1, 2) AND o_totalprice > 0 GROUP BY 1, 2
    """,
)
def unmapped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    measures = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        "o_orderpriority",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    report = crosswalk.unmapped_report(
        entities,
        _customer_clusters(spark, sf_dir),
        measures,
        "id",
        ["o_orderpriority"],
        "cents",
        "total",
    )
    return report.withColumn("total", F.round(F.col("total") / 100, 2))


# --- hierarchy ------------------------------------------------------------------------


@query(
    "hierarchy_flatten",
    """
    SELECT n_regionkey AS region_key, r_name AS label, n_nationkey AS nation_key,
           n_name AS label_nation, c_custkey AS customer_key, c_name AS label_customer,
           o_orderkey AS order_key, o_orderpriority AS label_order
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
    LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
    """,
)
def hierarchy_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = [
        ("region", table(spark, sf_dir, "region").selectExpr("r_regionkey region_key", "r_name label")),
        (
            "nation",
            table(spark, sf_dir, "nation").selectExpr(
                "n_nationkey nation_key", "n_regionkey Parent_region_key", "n_name label"
            ),
        ),
        (
            "customer",
            table(spark, sf_dir, "customer").selectExpr(
                "c_custkey customer_key", "c_nationkey Parent_nation_key", "c_name label"
            ),
        ),
        (
            "order",
            table(spark, sf_dir, "orders").selectExpr(
                "o_orderkey order_key", "o_custkey Parent_customer_key", "o_orderpriority label"
            ),
        ),
    ]
    keys = {level: f"{level}_key" for level, _ in levels}
    return hierarchy.flatten(levels, keys, "label")


@query(
    "hierarchy_identifiers",
    """
    WITH tree AS (
        SELECT 'n' || n_nationkey AS Site_INSPIRE_ID, lower(n_name) AS nameOfFeature,
               'c' || (CASE WHEN c_custkey % 5 IN (1, 2) THEN c_custkey - c_custkey % 5
                            ELSE c_custkey END) AS Facility_INSPIRE_ID,
               lower(c_name) AS nameOfFeature_Facility, 'o' || o_orderkey AS Installation_INSPIRE_ID,
               lower(o_orderpriority) AS nameOfFeature_Installation,
               'l' || l_orderkey || '-' || l_linenumber AS Installation_Part_INSPIRE_ID,
               lower(l_returnflag) AS nameOfFeature_Installation_Part
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
        LEFT JOIN orders ON o_custkey = c_custkey
        LEFT JOIN lineitem ON l_orderkey = o_orderkey
    )
    SELECT * FROM tree
    UNION BY NAME
    SELECT 's' || s_suppkey AS Installation_Part_INSPIRE_ID, 'c' || (s_suppkey * 3)
        AS Facility_INSPIRE_ID FROM supplier
    """,
)
def hierarchy_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four levels, facilities rewired, older plants appended, everything lower case."""
    site = table(spark, sf_dir, "nation").select(
        _text_id("N", "n_nationkey").alias("Site_INSPIRE_ID"),
        F.col("n_name").alias("nameOfFeature"),
    )
    facility = table(spark, sf_dir, "customer").select(
        _text_id("C", "c_custkey").alias("Facility_INSPIRE_ID"),
        _text_id("N", "c_nationkey").alias("Parent_Site_INSPIRE_ID"),
        F.col("c_name").alias("nameOfFeature"),
    )
    installation = table(spark, sf_dir, "orders").select(
        _text_id("O", "o_orderkey").alias("Installation_INSPIRE_ID"),
        _text_id("C", "o_custkey").alias("Parent_Facility_INSPIRE_ID"),
        F.col("o_orderpriority").alias("nameOfFeature"),
    )
    part = table(spark, sf_dir, "lineitem").select(
        F.concat(_text_id("L", "l_orderkey"), _text_id("-", "l_linenumber")).alias(
            "Installation_Part_INSPIRE_ID"
        ),
        _text_id("O", "l_orderkey").alias("Parent_Installation_INSPIRE_ID"),
        F.col("l_returnflag").alias("nameOfFeature"),
    )
    clusters = _customer_clusters(spark, sf_dir).select(
        _text_id("C", "id").alias("Facility_INSPIRE_ID"),
        _text_id("C", "id_cluster").alias("Facility_INSPIRE_ID_cluster"),
    )
    links = table(spark, sf_dir, "supplier").select(
        _text_id("S", "s_suppkey").alias("Unique_Plant_ID"),
        _text_id("C", F.col("s_suppkey") * 3).alias("Facility_INSPIRE_ID"),
    )
    return hierarchy.identifiers(
        site, facility, installation, part, clusters, links, case_sensitive=False
    )


# --- files: written from the given tables, read back typed -----------------------------

_NA_LIST = ", ".join(f"'{v}'" for v in NA_VALUES)
_AS_OF = "2000-06-30"


@query(
    "typed_csv_source",
    f"""
    SELECT CAST(o_orderkey AS INTEGER) AS fileId,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL
                WHEN o_orderkey % 5 = 0 THEN o_orderpriority || chr(10) || '"second", line'
                ELSE o_orderpriority END AS envelopeUrl,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS amount,
           CASE WHEN o_orderkey % 13 = 0
                  OR strftime(o_orderdate, '%m/%d/%y %H:%M:%S') IN ({_NA_LIST}) THEN NULL
                WHEN o_orderdate > DATE '{_AS_OF}' THEN o_orderdate - INTERVAL 100 YEAR
                ELSE o_orderdate END AS dateSubmitted,
           o_orderstatus = 'F' AS done
    FROM orders
    """,
)
def typed_csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinels, bad numbers, line breaks in fields and two-digit years, read back typed."""
    key = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("fileId"),
        F.when(key % 11 == 0, F.lit("CONFIDENTIAL"))
        .when(key % 5 == 0, F.concat("o_orderpriority", F.lit('\n"second", line')))
        .otherwise(F.col("o_orderpriority"))
        .alias("envelopeUrl"),
        F.when(key % 7 == 0, F.lit("about 5"))
        .otherwise(F.round("o_totalprice", 2).cast("string"))
        .alias("amount"),
        F.when(key % 13 == 0, F.lit("01/02/00 00:00:00"))
        .otherwise(F.date_format("o_orderdate", DATE_FORMAT))
        .alias("dateSubmitted"),
        (F.col("o_orderstatus") == "F").cast("string").alias("done"),
        F.lit("not declared").alias("extra"),
    )
    path = f"{stage_path(spark, 'orders')}.csv"
    raw.write.csv(path, header=True, escape='"')
    schema = T.StructType.fromDDL(
        "fileId int, envelopeUrl string, amount double, dateSubmitted timestamp_ntz, done boolean"
    )
    csv_source.read_typed_csv(spark, path, schema, NA_VALUES, _AS_OF)
    return csv_source.read_typed_csv(spark, path, schema, NA_VALUES, _AS_OF)


@query(
    "ordered_csv_sink",
    "SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS weight FROM customer",
)
def ordered_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosswalk written in global order and read back with its declared schema."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.round("c_acctbal", 2).alias("weight"),
    )
    path = stage_path(spark, "crosswalk")
    sinks.write_ordered_csv(rows, path, ["id"])
    return spark.read.csv(path, schema="id bigint, name string, weight double", header=True)


@query("parquet_stage", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def parquet_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet sink partitioned by a column, and source; the named relation is made once."""
    path = stage_path(spark, "supplier")
    sinks.write_parquet(table(spark, sf_dir, "supplier"), path, ["s_nationkey"])
    named = NamedStages(spark)
    named.table(spark.read.parquet(path), "supplier")
    return named.table(spark.read.parquet(path), "supplier")


@query(
    "surrogate_ids",
    """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS surrogate
    FROM orders
    """,
)
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered by date without gathering them in one task."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    numbered = with_dense_ids(orders, ["o_orderdate", "o_orderkey"], "surrogate")
    return numbered.select("o_orderkey", "surrogate")


# --- text -----------------------------------------------------------------------------


@query(
    "clean_text",
    r"""
    SELECT doc_id,
           nullif(trim(replace(
               trim(regexp_replace(lower(strip_accents(text)), '[^\w\s]', '', 'g')),
               coalesce(trim(regexp_replace(lower(source), '[^\w\s]', '', 'g')), ''), '')), '')
               AS cleaned
    FROM documents
    """,
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", names.clean("text", remove=["source"]).alias("cleaned")
    )


_LEGAL_SQL = """
    SELECT DISTINCT word
    FROM benchmark,
         unnest(list_filter(
             list_transform(regexp_split_to_array(text, '[; ]'),
                            lambda part: regexp_replace(lower(part), '[^a-z0-9]', '', 'g')),
             lambda part: length(part) > 0)) AS found(word)
"""


def _legal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.stop_words(table(spark, sf_dir, "benchmark"), ["text"])


@query("stop_word_list", _LEGAL_SQL)
def stop_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legal_words(spark, sf_dir)


@query(
    "strip_stopwords",
    f"""
    SELECT doc_id, lang,
           nullif(array_to_string(
               list_filter(string_split(text, ' '), lambda w: NOT list_contains(
                   stops, regexp_replace(w, '[^a-z0-9]', '', 'gi'))), ' '), '') AS text
    FROM documents, (SELECT list(word) AS stops FROM ({_LEGAL_SQL}))
    """,
)
def strip_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return names.strip_stop_words(documents, _legal_words(spark, sf_dir), ["text"])
