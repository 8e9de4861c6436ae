"""Queries: projections, filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import ordered
from panelforge.functions.series import median
from panelforge.operators import joins
from panelforge.operators.quantile import positive_quantiles
from panelforge.plans.derived import ANNUAL_SQL, annual_panel, table, year_of
from panelforge.plans.registry import query


@query(
    "projection_forms",
    """
    SELECT o_orderkey AS Child_ID, o_custkey AS Parent_ID, upper(o_orderstatus) AS o_orderstatus,
           round(o_totalprice / 2, 4) AS half, round(o_totalprice / 2, 4) * 3 AS triple_half,
           o_orderdate
    FROM orders
    """,
)
def projection_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star with additions, exclusion, replacement in place, renaming, reuse of a new column."""
    return (
        table(spark, sf_dir, "orders")
        .withColumn("o_orderstatus", F.upper("o_orderstatus"))
        .withColumn("half", F.round(F.col("o_totalprice") / 2, 4))
        .withColumn("triple_half", F.col("half") * 3)
        .withColumnsRenamed({"o_orderkey": "Child_ID", "o_custkey": "Parent_ID"})
        .drop("o_totalprice", "o_orderpriority")
    )


@query(
    "all_columns_lower",
    """
    SELECT lower(CAST(c_custkey AS VARCHAR)) AS c_custkey, lower(c_name) AS c_name,
           lower(c_mktsegment) AS c_mktsegment
    FROM customer
    """,
)
def all_columns_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return source.select(*[F.lower(F.col(c).cast("string")).alias(c) for c in source.columns])


@query(
    "filter_forms",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag
    FROM lineitem
    WHERE l_returnflag IN ('A', 'N') AND NOT (l_linestatus = 'O' AND l_quantity > 30)
      AND (l_discount BETWEEN 0.02 AND 0.07 OR l_tax IS NOT DISTINCT FROM 0.0)
      AND l_shipdate IS NOT NULL
      AND (nullif(l_returnflag, 'A') IS NULL) <> (nullif(l_linestatus, 'F') IS NULL)
    """,
)
def filter_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, lists, negated groups, ranges, null-safe equality, one-side-missing."""
    flag_missing = F.nullif("l_returnflag", F.lit("A")).isNull()
    status_missing = F.nullif("l_linestatus", F.lit("F")).isNull()
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag").isin("A", "N"))
        .where(~((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 30)))
        .where(F.col("l_discount").between(0.02, 0.07) | F.col("l_tax").eqNullSafe(0.0))
        .where(F.col("l_shipdate").isNotNull() & (flag_missing != status_missing))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    )


@query(
    "regex_predicate",
    r"""
    SELECT p_partkey, p_name FROM part
    WHERE regexp_matches(p_name, '(?i)(?:WIDGET|^small )')
    """,
)
def regex_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_name").rlike("(?i)(?:WIDGET|^small )"))
        .select("p_partkey", "p_name")
    )


@query(
    "left_join_using",
    """
    SELECT o_orderkey, c_name, n_name
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'MACHINERY'
    LEFT JOIN nation ON c_nationkey = n_nationkey
    """,
)
def left_join_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = (
        table(spark, sf_dir, "customer")
        .where(F.col("c_mktsegment") == "MACHINERY")
        .select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    )
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .join(customers, "o_custkey", "left")
        .join(nations, "c_nationkey", "left")
        .select("o_orderkey", "c_name", "n_name")
    )


@query(
    "inner_join_aggregate",
    """
    SELECT c_mktsegment, n_name, count(*) AS n, min(o_totalprice) AS lowest,
           max(o_totalprice) AS highest, round(avg(CAST(round(o_totalprice * 100) AS BIGINT)), 4) AS mean,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ALL
    """,
)
def inner_join_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    orders = table(spark, sf_dir, "orders")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
        .groupBy("c_mktsegment", "n_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("o_totalprice").alias("lowest"),
            F.max("o_totalprice").alias("highest"),
            F.round(F.avg(F.round(F.col("o_totalprice") * 100).cast("long")), 4).alias("mean"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        )
    )


@query(
    "anti_join",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
    """,
)
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    return (
        table(spark, sf_dir, "customer")
        .join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
        .select("c_custkey", "c_name")
    )


@query(
    "nullsafe_join",
    """
    SELECT CAST(count(*) AS BIGINT) AS n, l.code AS code
    FROM (SELECT user_id, nullif(event_type, 'error') AS code FROM events) l
    JOIN (SELECT DISTINCT nullif(event_type, 'error') AS code FROM events) r
      ON l.code IS NOT DISTINCT FROM r.code
    GROUP BY l.code
    """,
)
def nullsafe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.nullif("event_type", F.lit("error")).alias("code")
    )
    codes = rows.select("code").distinct()
    joined = joins.null_safe_join(rows, codes, ["code"], "inner")
    return joined.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "star_join",
    """
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, o.o_custkey,
           o.o_orderdate, p.p_name, p.p_brand, s.s_name, s.s_nationkey
    FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
    LEFT JOIN part p ON p.p_partkey = l.l_partkey
    LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
    """,
)
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"
    )
    result = facts
    for dimension, key in ((orders, "l_orderkey"), (parts, "l_partkey"), (suppliers, "l_suppkey")):
        result = joins.star_join(result, [dimension], key)
    return result


@query(
    "having_distinct",
    """
    SELECT o_custkey, count(DISTINCT o_orderpriority) AS priorities, min(o_orderpriority) AS only
    FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) <= 2
    """,
)
def having_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_totalprice") > 0)
        .groupBy("o_custkey")
        .agg(
            F.countDistinct("o_orderpriority").alias("priorities"),
            F.min("o_orderpriority").alias("only"),
        )
        .where(F.col("priorities") <= 2)
    )


@query(
    "median_grouped",
    """
    SELECT o_custkey, round(median(o_totalprice), 6) AS mid
    FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey
    """,
)
def median_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of raw rows: a customer may have any number, so ranks are found by digits."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    medians = positive_quantiles(orders, "o_totalprice", ["o_custkey"], {"mid": 0.5})
    return medians.withColumn("mid", F.round("mid", 6))


@query(
    "median_of_panel",
    f"SELECT unit, code, round(median(v), 6) AS mid FROM ({ANNUAL_SQL}) GROUP BY 1, 2",
)
def median_of_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of annual series: a group holds one value per year."""
    return (
        annual_panel(spark, sf_dir)
        .groupBy("unit", "code")
        .agg(F.round(median(F.col("v")), 6).alias("mid"))
    )


@query(
    "conditional_aggregates",
    """
    SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END)::BIGINT AS done,
           count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
           max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
           bool_and(o_totalprice > 1000) AS all_large, bool_or(o_totalprice > 450000) AS any_huge,
           CAST(max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS INTEGER) AS has_pending
    FROM orders GROUP BY o_custkey
    """,
)
def conditional_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.sum(F.when(status == "F", 1)).alias("done"),
            F.count_if(status == "O").alias("open"),
            F.max(F.when(F.col("o_orderpriority") == "1-URGENT", price)).alias("urgent"),
            F.bool_and(price > 1000).alias("all_large"),
            F.bool_or(price > 450000).alias("any_huge"),
            F.max(status == "P").cast("int").alias("has_pending"),
        )
    )


@query(
    "ordered_first_last",
    """
    SELECT o_custkey,
           first(o_orderpriority ORDER BY o_orderdate, o_orderpriority) AS first_priority,
           last(o_orderpriority ORDER BY o_orderdate, o_orderpriority) AS last_priority,
           last(o_totalprice ORDER BY nullif(o_orderpriority, '5-LOW'), o_totalprice) AS last_price
    FROM orders GROUP BY o_custkey
    """,
)
def ordered_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            ordered.first_value("o_orderpriority", "o_orderdate").alias("first_priority"),
            ordered.last_value("o_orderpriority", "o_orderdate").alias("last_priority"),
            ordered.last_value(
                "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW"))
            ).alias("last_price"),
        )
    )


@query(
    "first_non_null",
    """
    SELECT o_custkey,
           any_value(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END
                     ORDER BY o_orderdate, o_orderpriority) AS priority,
           any_value(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END
                     ORDER BY o_orderdate, o_totalprice) AS price
    FROM orders GROUP BY o_custkey
    """,
)
def first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            ordered.first_non_null(
                F.when(status == "O", F.col("o_orderpriority")), "o_orderdate"
            ).alias("priority"),
            ordered.first_non_null(
                F.when(status == "F", F.col("o_totalprice")), "o_orderdate"
            ).alias("price"),
        )
    )


@query(
    "arg_max_best",
    """
    SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best_order,
           arg_max(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, o_totalprice)
               AS best_priority
    FROM orders GROUP BY o_custkey
    """,
)
def arg_max_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            ordered.value_at_max("o_orderkey", "o_totalprice").alias("best_order"),
            ordered.value_at_max(settled, "o_totalprice").alias("best_priority"),
        )
    )


@query(
    "ordered_lists",
    f"""
    SELECT unit, array_to_string(list(CAST(v AS BIGINT) ORDER BY yr, code), ',') AS amounts,
           string_agg(code, ' ' ORDER BY yr, code) AS codes
    FROM ({ANNUAL_SQL}) GROUP BY unit
    """,
)
def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists per unit of an annual panel: at most years x codes entries."""
    amounts = ordered.ordered_list(F.col("v").cast("long").cast("string"), "yr", "code")
    return (
        annual_panel(spark, sf_dir)
        .groupBy("unit")
        .agg(
            F.array_join(amounts, ",").alias("amounts"),
            ordered.ordered_text("code", " ", "yr", "code").alias("codes"),
        )
    )


@query(
    "window_neighbours",
    f"""
    SELECT unit, code, yr, lag(v) OVER w AS v_before, lead(v) OVER w AS v_after,
           min(v) OVER (PARTITION BY unit, code) AS lowest,
           max(v) OVER (PARTITION BY unit, code) AS highest,
           count(v) OVER (PARTITION BY unit, code) AS n,
           bool_or(v > 700) OVER (PARTITION BY unit, code) AS any_large
    FROM ({ANNUAL_SQL}) WINDOW w AS (PARTITION BY unit, code ORDER BY yr)
    """,
)
def window_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring rows and whole-series aggregates over annual series."""
    unit = Window.partitionBy("unit", "code")
    years = unit.orderBy("yr")
    return annual_panel(spark, sf_dir).select(
        "unit",
        "code",
        "yr",
        F.lag("v").over(years).alias("v_before"),
        F.lead("v").over(years).alias("v_after"),
        F.min("v").over(unit).alias("lowest"),
        F.max("v").over(unit).alias("highest"),
        F.count("v").over(unit).alias("n"),
        F.bool_or(F.col("v") > 700).over(unit).alias("any_large"),
    )


@query(
    "window_medians",
    """
    SELECT unit, yr, round(median(v) OVER (PARTITION BY unit), 6) AS whole,
           round(median(v) FILTER (WHERE v > 1000) OVER (PARTITION BY unit), 6) AS whole_large,
           round(median(v) FILTER (WHERE v > 1000) OVER (
               PARTITION BY unit ORDER BY yr ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6)
               AS before_large,
           round(median(v) FILTER (WHERE v > 1000) OVER (
               PARTITION BY unit ORDER BY yr ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6)
               AS around_large
    FROM (
        SELECT o_custkey AS unit, CAST(year(o_orderdate) AS BIGINT) AS yr,
               max(o_totalprice) AS v FROM orders GROUP BY 1, 2
    )
    """,
)
def window_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = Window.partitionBy("unit")
    years = unit.orderBy("yr")
    large = F.when(F.col("v") > 1000, F.col("v"))
    panel = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("unit"), year_of("o_orderdate").alias("yr"))
        .agg(F.max("o_totalprice").alias("v"))
    )
    return panel.select(
        "unit",
        "yr",
        F.round(median(F.col("v")).over(unit), 6).alias("whole"),
        F.round(median(large).over(unit), 6).alias("whole_large"),
        F.round(median(large).over(years.rowsBetween(-4, -1)), 6).alias("before_large"),
        F.round(median(large).over(years.rowsBetween(-2, 2)), 6).alias("around_large"),
    )


@query(
    "top_per_key",
    """
    SELECT c_nationkey, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (
            PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS rank
        FROM customer
    ) WHERE rank <= 3
    """,
)
def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy(
        "c_mktsegment", F.col("c_acctbal").desc(), "c_custkey"
    )
    return (
        table(spark, sf_dir, "customer")
        .withColumn("rank", F.row_number().over(order))
        .where("rank <= 3")
        .select("c_nationkey", "c_custkey", "c_acctbal", "rank")
    )


@query(
    "top_inspection",
    """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5
    """,
)
def top_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: a report of the five largest."""
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.col("o_totalprice").desc(), "o_orderkey")
        .limit(5)
    )


@query(
    "union_all",
    """
    SELECT s_name AS name, s_nationkey AS nation FROM supplier
    UNION ALL SELECT c_name, c_nationkey FROM customer
    """,
)
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_name name", "s_nationkey nation")
    customers = table(spark, sf_dir, "customer").selectExpr("c_name name", "c_nationkey nation")
    return suppliers.union(customers)


@query(
    "union_distinct_exploded",
    """
    SELECT DISTINCT word FROM (
        SELECT unnest(string_split(p_name, ' ')) AS word FROM part
        UNION SELECT unnest(string_split(p_type, ' ')) FROM part
        UNION SELECT unnest(string_split(p_brand, '#')) FROM part
        UNION SELECT unnest(string_split(c_mktsegment, ' ')) FROM customer
    )
    """,
)
def union_distinct_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    words = [
        part.select(F.explode(F.split("p_name", " ")).alias("word")),
        part.select(F.explode(F.split("p_type", " ")).alias("word")),
        part.select(F.explode(F.split("p_brand", "#")).alias("word")),
        customer.select(F.explode(F.split("c_mktsegment", " ")).alias("word")),
    ]
    return reduce(DataFrame.union, words).distinct()


@query(
    "union_by_name_distinct",
    """
    SELECT o_custkey AS id, CAST(year(o_orderdate) AS BIGINT) AS yr, o_orderpriority AS note,
           NULL::VARCHAR AS name
    FROM orders
    UNION
    SELECT c_custkey, NULL, NULL, c_name FROM customer
    """,
)
def union_by_name_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        year_of("o_orderdate").alias("yr"),
        F.col("o_orderpriority").alias("note"),
    )
    customers = table(spark, sf_dir, "customer").selectExpr("c_name name", "c_custkey id")
    return joins.union_distinct_by_name(orders, customers)


@query(
    "unpivot_measures",
    """
    SELECT l_suppkey, yr, measure, value FROM (
        UNPIVOT (
            SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS yr,
                   max(l_quantity) AS quantity, max(nullif(l_discount, 0.1)) AS discount,
                   max(CASE WHEN l_tax > 0.07 THEN l_tax END) AS tax
            FROM lineitem GROUP BY 1, 2
        ) ON COLUMNS(* EXCLUDE (l_suppkey, yr)) INTO NAME measure VALUE value
    )
    """,
)
def unpivot_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", year_of("l_shipdate").alias("yr"))
        .agg(
            F.max("l_quantity").alias("quantity"),
            F.max(F.nullif("l_discount", F.lit(0.1))).alias("discount"),
            F.max(F.when(F.col("l_tax") > 0.07, F.col("l_tax"))).alias("tax"),
        )
    )
    measures = ["quantity", "discount", "tax"]
    return joins.melt(totals, ["l_suppkey", "yr"], measures, "measure", "value")


@query(
    "outer_join_audit",
    """
    WITH f AS (SELECT o_custkey AS k, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS a
               FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    o AS (SELECT o_custkey AS k, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS b
          FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT coalesce(f.k, o.k) AS k, a, b FROM f FULL JOIN o ON f.k = o.k
    """,
)
def outer_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"),
        "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    done = orders.where("o_orderstatus = 'F'").groupBy("k").agg(F.sum("cents").alias("a"))
    open_ = orders.where("o_orderstatus = 'O'").groupBy("k").agg(F.sum("cents").alias("b"))
    return done.join(open_, "k", "outer")


@query(
    "not_in_pairs",
    """
    SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS BIGINT) AS yr FROM orders
    WHERE o_orderstatus = 'F' AND (o_custkey, year(o_orderdate)) NOT IN (
        SELECT (o_custkey, year(o_orderdate)) FROM orders WHERE o_orderstatus = 'O')
    """,
)
def not_in_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", year_of("o_orderdate").alias("yr"), "o_orderstatus"
    )
    done, open_ = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'")
    return joins.rows_not_listed(done, open_, "o_custkey", "yr").drop("o_orderstatus")


@query(
    "grid_of_codes",
    """
    SELECT u.o_custkey, y.yr, p.priority, p.medium
    FROM (SELECT DISTINCT o_custkey FROM orders) u
    CROSS JOIN (SELECT unnest(generate_series(1997, 1999)) AS yr) y
    CROSS JOIN (VALUES ('1-URGENT', 'AIR'), ('5-LOW', 'WATER')) AS p(priority, medium)
    """,
)
def grid_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit x period x constant pairs by exploding constants, without a join."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("priority"), F.lit(b).alias("medium"))
            for a, b in (("1-URGENT", "AIR"), ("5-LOW", "WATER"))
        ]
    )
    years = F.explode(F.sequence(F.lit(1997).cast("long"), F.lit(1999).cast("long")))
    return (
        table(spark, sf_dir, "orders")
        .select("o_custkey")
        .distinct()
        .select("o_custkey", years.alias("yr"))
        .select("*", F.explode(pairs).alias("_p"))
        .select("o_custkey", "yr", "_p.*")
    )


@query(
    "scalar_text",
    r"""
    SELECT c_custkey, upper(c_name) AS up, trim('  ' || c_name || ' ') AS trimmed,
           replace(c_mktsegment, 'M', 'm') AS swapped, nullif(c_mktsegment, 'BUILDING') AS seg,
           coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg_or_none,
           contains(c_name, '99') AS has_99,
           regexp_replace(c_name, '[^\w\s]', '', 'g') AS bare,
           regexp_extract(c_name, '([0-9]+)$', 1) AS digits,
           regexp_extract(c_name, '^(x+)', 1) AS no_match
    FROM customer
    """,
)
def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.upper("c_name").alias("up"),
        F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"),
        F.replace("c_mktsegment", F.lit("M"), F.lit("m")).alias("swapped"),
        segment.alias("seg"),
        F.coalesce(segment, F.lit("none")).alias("seg_or_none"),
        F.contains("c_name", F.lit("99")).alias("has_99"),
        F.regexp_replace("c_name", r"[^\w\s]", "").alias("bare"),
        F.regexp_extract("c_name", r"([0-9]+)$", 1).alias("digits"),
        F.regexp_extract("c_name", r"^(x+)", 1).alias("no_match"),
    )


@query(
    "scalar_math",
    """
    SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN log10(s_acctbal) END, 9) AS lg,
           round(CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END, 9) AS natural,
           pow(10, s_nationkey % 4) AS p, abs(s_acctbal) AS size, sign(s_acctbal)::DOUBLE AS side,
           round(s_acctbal / 10) AS tens, greatest(s_acctbal, 100.0) AS floor,
           least(s_acctbal, NULL, 5000.0) AS cap, TRY_CAST(s_name AS DOUBLE) AS not_a_number,
           CAST(s_nationkey AS DOUBLE) AS nation,
           CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END
               AS ladder
    FROM supplier
    """,
)
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.round(F.log10(balance), 9).alias("lg"),
        F.round(F.ln(balance), 9).alias("natural"),
        F.pow(F.lit(10.0), F.col("s_nationkey") % 4).alias("p"),
        F.abs(balance).alias("size"),
        F.signum(balance).alias("side"),
        F.round(balance / 10).alias("tens"),
        F.greatest(balance, F.lit(100.0)).alias("floor"),
        F.least(balance, F.lit(None).cast("double"), F.lit(5000.0)).alias("cap"),
        F.col("s_name").try_cast("double").alias("not_a_number"),
        F.col("s_nationkey").cast("double").alias("nation"),
        F.when(balance < 0, "debt").when(balance < 5000, "low").otherwise("high").alias("ladder"),
    )


@query(
    "calendar_series",
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr,
           o_orderdate - INTERVAL 100 YEAR AS century_before,
           strptime(strftime(o_orderdate, '%m/%d/%y %H:%M:%S'), '%m/%d/%y %H:%M:%S') AS reparsed
    FROM orders
    """,
)
def calendar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.constants import DATE_FORMAT
    from panelforge.sources.csv_source import parse_short_date

    text = F.date_format("o_orderdate", DATE_FORMAT)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("yr"),
        (F.col("o_orderdate") - F.make_ym_interval(F.lit(100), F.lit(0))).alias("century_before"),
        parse_short_date(text, as_of="2025-01-01").alias("reparsed"),
    )


@query(
    "stage_as_view",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
)
def stage_as_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lazy relation under a name, read back with SQL."""
    view = "panelforge_orders"
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    return spark.sql(f"SELECT o_custkey, count(*) AS n FROM {view} GROUP BY o_custkey")
