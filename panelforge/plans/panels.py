"""Queries: panel shape and anomaly detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import anomaly, panel, quantile
from panelforge.operators.quantile_sketch import merge, sketch, sketch_quantiles
from panelforge.plans.derived import (
    ANNUAL_SQL,
    CORRUPT_SQL,
    DAILY_ROWS_SQL,
    DAILY_SQL,
    annual_panel,
    balanced_sql,
    corrupted_panel,
    daily_panel,
    daily_rows,
    table,
    year_of,
)
from panelforge.plans.registry import query
from panelforge.sources.staging import stage

_UNIT_CODE = ["unit", "code"]
_BALANCED_DAILY_SQL = balanced_sql(DAILY_SQL, "day", _UNIT_CODE)


def _balanced_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_rows(spark, sf_dir)
    return panel.balance(daily_panel(rows), "day", _UNIT_CODE, universe=rows)


@query("balance_panel", _BALANCED_DAILY_SQL)
def balance_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balanced_daily(spark, sf_dir)


_NULLED_SQL = f"""
    SELECT unit, CASE WHEN code <> 'error' THEN code END AS code, day, round(sum(v), 4) AS v
    FROM ({DAILY_ROWS_SQL}) GROUP BY 1, 2, 3
"""


@query("balance_nullsafe", balanced_sql(_NULLED_SQL, "day", _UNIT_CODE))
def balance_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_rows(spark, sf_dir).withColumn(
        "code", F.when(F.col("code") != "error", F.col("code"))
    )
    return panel.balance(daily_panel(rows), "day", _UNIT_CODE, universe=rows)


def _fill_sql(direction: str) -> str:
    ahead = """first_value(v IGNORE NULLS) OVER (
        PARTITION BY unit, code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""
    behind = """last_value(v IGNORE NULLS) OVER (
        PARTITION BY unit, code ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    donors = {"back": ahead, "forward": behind, "both": f"{ahead}, {behind}"}[direction]
    return f"""
        SELECT unit, code, day, coalesce(v, {donors}) AS v FROM ({_BALANCED_DAILY_SQL})
    """


@query("fill_forward", _fill_sql("forward"))
def fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.fill_series(_balanced_daily(spark, sf_dir), ["v"], _UNIT_CODE, "day", "forward")


@query("fill_back", _fill_sql("back"))
def fill_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.fill_series(_balanced_daily(spark, sf_dir), ["v"], _UNIT_CODE, "day", "back")


@query("fill_both", _fill_sql("both"))
def fill_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.fill_series(_balanced_daily(spark, sf_dir), ["v"], _UNIT_CODE, "day", "both")


@query(
    "fill_repeated",
    """
    WITH known AS (
        SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS BIGINT) AS yr,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS priority
        FROM orders
    )
    SELECT o_orderkey, o_custkey, yr,
           coalesce(
               priority,
               first_value(priority IGNORE NULLS) OVER (
                   PARTITION BY o_custkey ORDER BY yr, priority NULLS FIRST
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
               last_value(priority IGNORE NULLS) OVER (
                   PARTITION BY o_custkey ORDER BY yr, priority NULLS FIRST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS priority
    FROM known
    """,
)
def fill_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        year_of("o_orderdate").alias("yr"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("priority"),
    )
    return panel.fill_missing(known, {"priority": F.col("priority")}, ["o_custkey"], "yr")


@query(
    "fill_from_latest",
    """
    WITH known AS (
        SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS BIGINT) AS yr,
               CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS price
        FROM orders
    )
    SELECT o_orderkey, o_custkey, yr,
           coalesce(price, first_value(price IGNORE NULLS) OVER (
               PARTITION BY o_custkey ORDER BY yr DESC, price DESC NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS price
    FROM known
    """,
)
def fill_from_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        year_of("o_orderdate").alias("yr"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).alias("price"),
    )
    return panel.fill_from_latest(known, ["price"], ["o_custkey"], "yr")


@query(
    "interpolate_gaps",
    f"""
    WITH grid AS ({_BALANCED_DAILY_SQL}),
    known AS (SELECT unit, code, day, v FROM grid WHERE v IS NOT NULL),
    before AS (
        SELECT g.unit, g.code, g.day, max(k.day) AS d0
        FROM grid g JOIN known k ON k.unit = g.unit AND k.code = g.code AND k.day < g.day
        WHERE g.v IS NULL GROUP BY 1, 2, 3
    ),
    after AS (
        SELECT g.unit, g.code, g.day, min(k.day) AS d1
        FROM grid g JOIN known k ON k.unit = g.unit AND k.code = g.code AND k.day > g.day
        WHERE g.v IS NULL GROUP BY 1, 2, 3
    )
    SELECT g.unit, g.code, g.day,
           round(coalesce(g.v, k0.v + (k1.v - k0.v) * (g.day - b.d0)::DOUBLE / (a.d1 - b.d0)), 6)
               AS v
    FROM grid g
    LEFT JOIN before b USING (unit, code, day)
    LEFT JOIN after a USING (unit, code, day)
    LEFT JOIN known k0 ON k0.unit = g.unit AND k0.code = g.code AND k0.day = b.d0
    LEFT JOIN known k1 ON k1.unit = g.unit AND k1.code = g.code AND k1.day = a.d1
    """,
)
def interpolate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridged = panel.interpolate(_balanced_daily(spark, sf_dir), "v", _UNIT_CODE, "day")
    return bridged.withColumn("v", F.round("v", 6))


def jumps_sql(
    source: str,
    value: str,
    keys: list[str],
    time: str,
    delta: float,
    tolerance: float,
    scalar: str = "scalar",
    flag: str = "is_jump",
) -> str:
    """Reverting spikes of the source, spelled out step by step."""
    unit = ", ".join(keys)
    return f"""
        SELECT * EXCLUDE (v_before, v_after, lowest, highest, d_in, d_out),
               coalesce(
                   {scalar} IS NOT NULL AND abs(d_in) > {delta!r} AND abs(d_out) > {delta!r}
                   AND sign(d_in) <> sign(d_out)
                   AND {value} / pow(10, {scalar}) >= lowest * {1 - tolerance!r}
                   AND {value} / pow(10, {scalar}) <= highest * {1 + tolerance!r}, FALSE)
               AS {flag}
        FROM (
            SELECT *, nullif(round(d_in), 0) AS {scalar}
            FROM (
                SELECT *,
                       CASE WHEN {value} > 0 AND v_before > 0
                            THEN log10({value} / v_before) END AS d_in,
                       CASE WHEN {value} > 0 AND v_after > 0
                            THEN log10(v_after / {value}) END AS d_out
                FROM (
                    SELECT *,
                           lag({value}) OVER (PARTITION BY {unit} ORDER BY {time}) AS v_before,
                           lead({value}) OVER (PARTITION BY {unit} ORDER BY {time}) AS v_after,
                           min({value}) OVER (PARTITION BY {unit}) AS lowest,
                           max({value}) OVER (PARTITION BY {unit}) AS highest
                    FROM ({source})
                )
            )
        )
    """


def repaired_units_sql(
    source: str, value: str, keys: list[str], time: str, delta: float, tolerance: float
) -> str:
    flagged = jumps_sql(source, value, keys, time, delta, tolerance, "_scalar", "_fired")
    return f"""
        SELECT * EXCLUDE (_scalar, _fired)
               REPLACE (CASE WHEN _fired THEN {value} / pow(10, _scalar) ELSE {value} END
                        AS {value})
        FROM ({flagged})
    """


UNIT_ERROR = anomaly.UNIT_ERROR_LOG10


@query(
    "jump_flags",
    f"""
    SELECT unit, code, yr, round(v, 6) AS v, scalar, is_jump
    FROM ({jumps_sql(CORRUPT_SQL, "v", _UNIT_CODE, "yr", UNIT_ERROR, 0.5)})
    """,
)
def jump_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = anomaly.flag_jumps(corrupted_panel(spark, sf_dir), "v", _UNIT_CODE, "yr")
    return flagged.withColumn("v", F.round("v", 6))


@query(
    "sanitise_units",
    f"""
    SELECT unit, code, yr, round(v, 6) AS v
    FROM ({repaired_units_sql(CORRUPT_SQL, "v", _UNIT_CODE, "yr", UNIT_ERROR, 0.5)})
    """,
)
def sanitise_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = anomaly.repair_units(corrupted_panel(spark, sf_dir), "v", _UNIT_CODE, "yr")
    return repaired.withColumn("v", F.round("v", 6))


@query(
    "exact_quantiles",
    """
    SELECT l_returnflag AS code, CAST(year(l_shipdate) AS BIGINT) AS yr,
           round(quantile_cont(l_extendedprice, 0.95), 6) AS q95,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
           round(quantile_cont(l_extendedprice, 0.05), 6) AS q05
    FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1, 2
    """,
)
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("code"), year_of("l_shipdate").alias("yr"), "l_extendedprice"
    )
    result = quantile.positive_quantiles(
        rows, "l_extendedprice", ["code", "yr"], {"q95": 0.95, "q50": 0.5, "q05": 0.05}
    )
    return result.select("code", "yr", *[F.round(q, 6).alias(q) for q in ("q95", "q50", "q05")])


@query(
    "quantile_sketch",
    """
    WITH v AS (
        SELECT l_returnflag AS code, CAST(year(l_shipdate) AS BIGINT) AS yr, l_extendedprice AS v,
               ceil(ln(l_extendedprice) / ln(1.01 / 0.99)) AS bucket
        FROM lineitem WHERE l_extendedprice > 0
    ),
    counted AS (
        SELECT code, yr, bucket, sum(count(*)) OVER (PARTITION BY code, yr ORDER BY bucket) AS upto,
               sum(count(*)) OVER (PARTITION BY code, yr) AS total
        FROM v GROUP BY code, yr, bucket
    ),
    approximate AS (
        SELECT code, yr, 2 * pow(1.01 / 0.99, min(bucket) FILTER (upto >= ceil(total * 0.95)))
                         / (1.01 / 0.99 + 1) AS q95,
               2 * pow(1.01 / 0.99, min(bucket) FILTER (upto >= ceil(total * 0.5)))
                         / (1.01 / 0.99 + 1) AS q50
        FROM counted GROUP BY code, yr
    ),
    exact AS (
        SELECT code, yr, quantile_disc(v, 0.95) AS e95, quantile_disc(v, 0.5) AS e50
        FROM v GROUP BY code, yr
    )
    SELECT code, yr, round(q95, 6) AS q95, round(q50, 6) AS q50
    FROM approximate JOIN exact USING (code, yr)
    WHERE abs(q95 - e95) <= 0.010001 * e95 AND abs(q50 - e50) <= 0.010001 * e50
    """,
)
def quantile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from stored states of two parts of the table, merged.

    The SQL has only those that lie within the error of the exact ones, so all must.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("code"), year_of("l_shipdate").alias("yr"), "l_extendedprice",
        (F.col("l_shipdate") < "1997-01-01").alias("early"),
    )
    states = [
        stage(sketch(rows.where(part), "l_extendedprice", ["code", "yr"]), "sketch")
        for part in (F.col("early"), ~F.coalesce("early", F.lit(False)))
    ]
    found = sketch_quantiles(merge(states), {"q95": 0.95, "q50": 0.5})
    return found.select("code", "yr", *[F.round(q, 6).alias(q) for q in ("q95", "q50")])


def outliers_sql(
    source: str,
    ref: str,
    target: str,
    identifiers: list[str],
    groups: list[str],
    time: str,
    q: float,
    threshold: float,
) -> str:
    """Outlier verdicts of the source, helper columns included."""
    unit = ", ".join([*identifiers, *groups])
    cell = ", ".join([*groups, time])
    local = f"PARTITION BY {unit} ORDER BY {time} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING"
    floor = 0.1 / threshold
    medians = ", ".join(
        f"""coalesce(
                median({c}) FILTER (WHERE in_band) OVER ({local}),
                median({c}) OVER (PARTITION BY {unit})) AS {c}_median"""
        for c in (ref, target)
    )
    distances = ", ".join(
        f"""CASE WHEN {c} IS NOT NULL AND {c}_median > 0
                 THEN log10(greatest({c} / {c}_median, {floor!r})) END AS {c}_to_median"""
        for c in (ref, target)
    )
    return f"""
        SELECT *, far_target AND (far_ref OR NOT in_band) AS is_outlier
        FROM (
            SELECT *, abs({ref}_to_median) > log10({threshold!r}) AS far_ref,
                   abs({target}_to_median) > log10({threshold!r}) AS far_target
            FROM (
                SELECT *, {distances}
                FROM (
                    SELECT *, {medians}
                    FROM (
                        SELECT *, {ref} >= q_low AND {ref} <= q_high AS in_band
                        FROM (
                            SELECT *,
                                   quantile_cont({ref}, {q!r}) FILTER (WHERE {ref} > 0)
                                       OVER (PARTITION BY {cell}) AS q_high,
                                   quantile_cont({ref}, {1 - q!r}) FILTER (WHERE {ref} > 0)
                                       OVER (PARTITION BY {cell}) AS q_low
                            FROM ({source})
                        )
                    )
                )
            )
        )
    """


_RATIO_SQL = """
    SELECT unit, code, yr, qty, qty / price AS ratio
    FROM (
        SELECT l_suppkey AS unit, l_returnflag AS code, CAST(year(l_shipdate) AS BIGINT) AS yr,
               sum(l_quantity) * CASE WHEN (l_suppkey * 7 + year(l_shipdate)) % 41 = 0
                                      THEN 1000 ELSE 1 END AS qty,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price
        FROM lineitem GROUP BY l_suppkey, l_returnflag, year(l_shipdate)
    )
"""


def _ratio_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("unit"),
            F.col("l_returnflag").alias("code"),
            year_of("l_shipdate").alias("yr"),
        )
        .agg(F.sum("l_quantity").alias("qty"), F.sum(cents).alias("price"))
    )
    wrong = (F.col("unit") * 7 + F.col("yr")) % 41 == 0
    return cells.withColumn(
        "qty", F.col("qty") * F.when(wrong, F.lit(1000)).otherwise(F.lit(1))
    ).select("unit", "code", "yr", "qty", (F.col("qty") / F.col("price")).alias("ratio"))


@query(
    "proxy_outliers",
    f"""
    SELECT unit, code, yr, qty, round(ratio, 9) AS ratio, round(ratio_to_median, 6)
               AS ratio_to_median, round(qty_to_median, 6) AS qty_to_median,
           in_band AS is_in_range, is_outlier
    FROM ({outliers_sql(_RATIO_SQL, "ratio", "qty", ["unit"], ["code"], "yr", 0.95, 2.0)})
    """,
)
def proxy_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = anomaly.flag_outliers(
        _ratio_panel(spark, sf_dir), "ratio", "qty", ["unit"], ["code"], "yr", 0.95, 2.0
    )
    return judged.select(
        "unit",
        "code",
        "yr",
        "qty",
        F.round("ratio", 9).alias("ratio"),
        F.round("ratio_to_median", 6).alias("ratio_to_median"),
        F.round("qty_to_median", 6).alias("qty_to_median"),
        "is_in_range",
        "is_outlier",
    )


@query(
    "drop_ambiguous",
    """
    SELECT o_orderkey, o_custkey, o_orderpriority, yr, price
    FROM (
        SELECT o_orderkey, o_custkey, o_orderpriority,
               CAST(year(o_orderdate) AS BIGINT) AS yr,
               CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price
        FROM orders
    )
    QUALIFY count(price) OVER (PARTITION BY o_custkey, o_orderpriority, yr) <= 1
    """,
)
def drop_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderpriority",
        year_of("o_orderdate").alias("yr"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
    )
    return anomaly.drop_ambiguous(rows, "price", ["o_custkey", "o_orderpriority", "yr"])


# Return flag A plays the whole, N the part.
@query(
    "paired_series_errors",
    f"""
    WITH pair AS (
        SELECT unit, yr, max(v) FILTER (WHERE code = 'A') AS a, max(v) FILTER (WHERE code = 'N')
            AS n
        FROM ({CORRUPT_SQL}) WHERE code IN ('A', 'N') GROUP BY 1, 2
    ),
    steps AS (
        SELECT unit, yr, coalesce(a, 0) > coalesce(n, 0) AS more,
               lag(coalesce(a, 0) > coalesce(n, 0)) OVER w AS more_before,
               CASE WHEN a > 0 AND lag(a) OVER w > 0 THEN log10(a / lag(a) OVER w) END AS c
        FROM pair WINDOW w AS (PARTITION BY unit ORDER BY yr)
    )
    SELECT unit, yr FROM (
        SELECT *, lead(c) OVER (PARTITION BY unit ORDER BY yr) AS c_next FROM steps
    ) WHERE more <> more_before AND abs(c) > 0.3 AND abs(c_next) > 0.3 AND sign(c) <> sign(c_next)
    """,
)
def paired_series_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.paired_series_errors(
        corrupted_panel(spark, sf_dir), "v", "code", "A", "N", ["unit"], "yr"
    )


@query(
    "dense_vectors",
    f"""
    WITH cell AS (
        SELECT u.unit, y.yr, c.code, coalesce(max(p.v), 0) AS v
        FROM (SELECT DISTINCT unit FROM ({ANNUAL_SQL})) u
        CROSS JOIN (SELECT unnest(generate_series(1996, 2000)) AS yr) y
        CROSS JOIN (SELECT unnest(['A', 'R']) AS code) c
        LEFT JOIN ({ANNUAL_SQL}) p ON p.unit = u.unit AND p.yr = y.yr AND p.code = c.code
        GROUP BY 1, 2, 3
    )
    SELECT unit, array_to_string(list(CAST(v AS BIGINT) ORDER BY yr, code), ',') AS releases,
           sum(v) AS total_releases
    FROM cell GROUP BY unit
    """,
)
def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = panel.dense_vectors(
        annual_panel(spark, sf_dir), "unit", "yr", ["code"], "v", (1996, 2000), [("A",), ("R",)]
    )
    text = F.array_join(F.transform("releases", lambda x: x.cast("long").cast("string")), ",")
    return vectors.withColumn("releases", text)


@query(
    "trim_and_pivot",
    f"""
    WITH active AS (
        SELECT unit, code, min(day) AS d0, max(day) AS d1
        FROM ({DAILY_SQL}) GROUP BY 1, 2
    ),
    kept AS (
        SELECT g.* FROM ({_BALANCED_DAILY_SQL}) g JOIN active a
        ON g.unit = a.unit AND g.code = a.code AND g.day BETWEEN a.d0 AND a.d1
    )
    SELECT unit, day, max(v) FILTER (WHERE code = 'click') AS click,
           max(v) FILTER (WHERE code = 'purchase') AS purchase
    FROM kept GROUP BY 1, 2
    """,
)
def trim_and_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = panel.trim_to_active_span(_balanced_daily(spark, sf_dir), "v", _UNIT_CODE, "day")
    return panel.pivot_wide(trimmed, ["unit", "day"], "code", "v", ["click", "purchase"])
