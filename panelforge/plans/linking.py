"""Queries: record linkage on orders of the same customer, and pairwise similarities.

Orders play records that may describe the same thing; settled orders (status F) form the
left register, the others the right one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.geo import distance_km
from panelforge.functions.similarity import cosine, jaro_winkler
from panelforge.linkage import levels as lv
from panelforge.linkage.blocking import Rule, block_on, block_sizes, candidate_pairs
from panelforge.linkage.clusters import clusters
from panelforge.linkage.model import (
    Model,
    deterministic_pairs,
    estimate_u,
    fit,
    parameters,
    pattern_counts,
    random_pairs,
    starting_model,
)
from panelforge.linkage.score import (
    indexed_pairs,
    per_pattern,
    predict,
    probability,
    score,
    term_frequencies,
)
from panelforge.operators.crosswalk import best_match, one_to_one_matching
from panelforge.plans.derived import table, year_of
from panelforge.plans.registry import query
from panelforge.sources.staging import stage

_RECORD_SQL = """
    SELECT o_orderkey AS id, o_custkey AS customer, o_orderpriority AS priority,
           o_orderstatus AS status, o_totalprice AS price,
           CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mon,
           CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day
    FROM orders
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        year_of("o_orderdate").alias("yr"),
        F.month("o_orderdate").cast("long").alias("mon"),
        day.cast("long").alias("day"),
    )


def _registers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = _records(spark, sf_dir)
    return records.where("status = 'F'"), records.where("status <> 'F'")


_REGISTERS_SQL = f"""
    rec AS ({_RECORD_SQL}),
    l AS (SELECT * FROM rec WHERE status = 'F'),
    r AS (SELECT * FROM rec WHERE status <> 'F')
"""
_RULES = [("customer", "priority"), ("customer", "yr", "mon")]


@query(
    "blocked_pairs",
    f"""
    WITH {_REGISTERS_SQL}
    SELECT l.id AS id_l, r.id AS id_r,
           CAST(CASE WHEN l.priority = r.priority THEN 0 ELSE 1 END AS INTEGER) AS match_key
    FROM l JOIN r ON l.customer = r.customer
    WHERE l.priority = r.priority OR (l.yr = r.yr AND l.mon = r.mon)
    """,
)
def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _registers(spark, sf_dir)
    pairs = candidate_pairs(left, right, "id", [block_on(*keys) for keys in _RULES])
    return pairs.select("id_l", "id_r", "match_key")


@query(
    "blocked_pairs_dedupe",
    f"""
    WITH rec AS ({_RECORD_SQL})
    SELECT l.id AS id_l, r.id AS id_r,
           CAST(CASE WHEN l.priority = r.priority THEN 0 ELSE 1 END AS INTEGER) AS match_key
    FROM rec l JOIN rec r ON l.customer = r.customer AND l.id < r.id
    WHERE l.priority = r.priority OR (l.yr = r.yr AND l.mon = r.mon)
    """,
)
def blocked_pairs_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [block_on(*keys) for keys in _RULES]
    # Tiny tiles, so that the test tables exercise the splitting of hot blocks.
    pairs = candidate_pairs(_records(spark, sf_dir), None, "id", rules, tile_rows=3)
    return pairs.select("id_l", "id_r", "match_key")


@query(
    "range_block_pairs",
    f"""
    WITH rec AS ({_RECORD_SQL})
    SELECT l.id AS id_l, r.id AS id_r FROM rec l JOIN rec r
    ON l.customer = r.customer AND l.priority = r.priority AND l.yr < r.yr
    """,
)
def range_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule(("customer", "priority"), before=("yr", "yr"))
    pairs = candidate_pairs(_records(spark, sf_dir), None, "id", [rule], directed=True)
    return pairs.select("id_l", "id_r")


@query(
    "block_sizes",
    f"""
    WITH {_REGISTERS_SQL}
    SELECT l.customer, l.n AS n_l, r.n AS n_r, CAST(l.n * r.n AS DOUBLE) AS pairs
    FROM (SELECT customer, count(*) AS n FROM l GROUP BY 1) l
    JOIN (SELECT customer, count(*) AS n FROM r GROUP BY 1) r ON l.customer = r.customer
    """,
)
def block_sizes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_sizes(*_registers(spark, sf_dir), ["customer"])


def _comparisons() -> tuple[lv.Comparison, ...]:
    return (
        lv.compare(
            "price",
            lv.null_level("price"),
            lv.within_share("price", 0.01),
            lv.within_share("price", 0.1),
            lv.within_share("price", 0.25),
            lv.otherwise(),
        ),
        lv.compare(
            "day",
            lv.null_level("day"),
            lv.exact("day"),
            lv.within_difference("day", 7),
            lv.within_difference("day", 90),
            lv.otherwise(),
        ),
        lv.exact_match("priority", tf=True),
        lv.compare(
            "season",
            lv.null_when((F.col("mon_l") == 1) & (F.col("mon_r") == 1), "mon"),
            lv.all_of(lv.exact("mon"), lv.exact("yr")),
            lv.any_of(lv.exact("mon"), lv.exact("yr")),
            lv.otherwise(),
        ),
    )


_GAMMA_SQL = """
    CAST(CASE WHEN l.price IS NULL OR r.price IS NULL THEN -1
         WHEN abs(l.price - r.price) / greatest(l.price, r.price) < 0.01 THEN 3
         WHEN abs(l.price - r.price) / greatest(l.price, r.price) < 0.1 THEN 2
         WHEN abs(l.price - r.price) / greatest(l.price, r.price) < 0.25 THEN 1
         ELSE 0 END AS INTEGER) AS gamma_price,
    CAST(CASE WHEN l.day IS NULL OR r.day IS NULL THEN -1 WHEN l.day = r.day THEN 3
         WHEN abs(l.day - r.day) <= 7 THEN 2 WHEN abs(l.day - r.day) <= 90 THEN 1
         ELSE 0 END AS INTEGER) AS gamma_day,
    CAST(CASE WHEN l.priority IS NULL OR r.priority IS NULL THEN -1
         WHEN l.priority = r.priority THEN 1 ELSE 0 END AS INTEGER) AS gamma_priority,
    CAST(CASE WHEN l.mon = 1 AND r.mon = 1 THEN -1 WHEN l.mon = r.mon AND l.yr = r.yr THEN 2
         WHEN l.mon = r.mon OR l.yr = r.yr THEN 1 ELSE 0 END AS INTEGER) AS gamma_season
"""


@query(
    "comparison_levels",
    f"""
    WITH {_REGISTERS_SQL}
    SELECT l.id AS id_l, r.id AS id_r, {_GAMMA_SQL}
    FROM l JOIN r ON l.customer = r.customer
    WHERE l.priority = r.priority OR (l.yr = r.yr AND l.mon = r.mon)
    """,
)
def comparison_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _registers(spark, sf_dir)
    comparisons = _comparisons()
    pairs = candidate_pairs(left, right, "id", [block_on(*keys) for keys in _RULES])
    graded = lv.with_gammas(pairs, comparisons)
    return graded.select("id_l", "id_r", *[c.gamma for c in comparisons])


@query(
    "gamma_patterns",
    f"""
    WITH {_REGISTERS_SQL},
    g AS (
        SELECT {_GAMMA_SQL} FROM l JOIN r ON l.customer = r.customer
        WHERE l.priority = r.priority OR (l.yr = r.yr AND l.mon = r.mon)
    )
    SELECT gamma_price, gamma_day, gamma_priority, gamma_season, count(*) AS pairs
    FROM g GROUP BY ALL
    """,
)
def gamma_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _registers(spark, sf_dir)
    pairs = candidate_pairs(left, right, "id", [block_on(*keys) for keys in _RULES])
    return pattern_counts(pairs, _comparisons())


# A fixed model: (m, u) per comparison and level.
_PRIOR = 0.001
_FIXED = {
    "price": {3: (0.8, 0.004), 2: (0.1, 0.06), 1: (0.05, 0.1), 0: (0.05, 0.836)},
    "day": {3: (0.6, 0.0005), 2: (0.2, 0.005), 1: (0.1, 0.06), 0: (0.1, 0.9345)},
    "priority": {1: (0.9, 0.2), 0: (0.1, 0.8)},
    "season": {2: (0.6, 0.01), 1: (0.2, 0.2), 0: (0.2, 0.79)},
}


def _fixed_model(tf: bool) -> Model:
    comparisons = _comparisons()
    if not tf:
        comparisons = (*comparisons[:2], lv.exact_match("priority"), comparisons[3])
    return Model(
        comparisons,
        _PRIOR,
        {n: {g: m for g, (m, _) in by.items()} for n, by in _FIXED.items()},
        {n: {g: u for g, (_, u) in by.items()} for n, by in _FIXED.items()},
    )


def _weight_sql() -> str:
    terms = [repr(math.log2(_PRIOR / (1 - _PRIOR)))]
    for name, by in _FIXED.items():
        cases = " ".join(f"WHEN {g} THEN {math.log2(m / u)!r}" for g, (m, u) in by.items())
        terms.append(f"CASE gamma_{name} {cases} ELSE 0.0 END")
    return " + ".join(terms)


_SCORED_SQL = f"""
    WITH {_REGISTERS_SQL},
    g AS (
        SELECT l.id AS id_l, r.id AS id_r, l.priority AS priority, {_GAMMA_SQL}
        FROM l JOIN r ON l.customer = r.customer
    ),
    scored AS (SELECT *, CAST({_weight_sql()} AS DOUBLE) AS w FROM g)
"""
_SCORE_COLUMNS_SQL = """id_l, id_r, round(w, 6) AS match_weight,
    round(1 - 1 / (1 + pow(2, w)), 9) AS match_probability"""


def _rounded(pairs: DataFrame, *carry: str) -> DataFrame:
    return pairs.select(
        "id_l",
        "id_r",
        F.round("match_weight", 6).alias("match_weight"),
        F.round("match_probability", 9).alias("match_probability"),
        *carry,
    )


def _rounded_by_pattern(pairs: DataFrame, model: Model, least: float, *carry: str) -> DataFrame:
    """As ``_rounded``, but each pattern's numbers are rounded once, not each pair's."""
    weight = per_pattern(model, lambda w: F.round(w, 6), least)
    chance = per_pattern(model, lambda w: F.round(probability(w), 9), least)
    return pairs.select(
        "id_l", "id_r", weight.alias("match_weight"), chance.alias("match_probability"), *carry
    )


@query(
    "score_fixed_model",
    f"""{_SCORED_SQL} SELECT {_SCORE_COLUMNS_SQL} FROM scored
    WHERE gamma_priority = 1 AND w >= -6""",
)
def score_fixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _registers(spark, sf_dir)
    pairs = candidate_pairs(left, right, "id", [block_on("customer", "priority")])
    return _rounded(score(pairs, _fixed_model(tf=False)).where("match_weight >= -6"))


@query(
    "predict_indexed",
    f"{_SCORED_SQL} SELECT {_SCORE_COLUMNS_SQL} FROM scored WHERE w >= 0.5",
)
def predict_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block by customer alone: pairs come from index keys, not from the whole block."""
    left, right = _registers(spark, sf_dir)
    return _rounded(
        predict(left, right, "id", [block_on("customer")], _fixed_model(tf=False), 0.5)
    )


@query(
    "term_frequencies",
    """
    SELECT o_orderpriority, round(count(*) / (SELECT count(*) FROM orders), 9) AS tf
    FROM orders GROUP BY 1
    """,
)
def term_frequencies_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = term_frequencies(table(spark, sf_dir, "orders"), "o_orderpriority")
    return tf.withColumn("tf", F.round("tf", 9))


@query(
    "tf_adjust",
    f"""
    {_SCORED_SQL},
    tf AS (SELECT priority, count(*) / (SELECT count(*) FROM rec) AS f FROM rec GROUP BY 1),
    adjusted AS (
        SELECT id_l, id_r,
               w + CASE WHEN gamma_priority = 1 THEN log2({_FIXED["priority"][1][1]} / f)
                        ELSE 0 END AS w
        FROM scored JOIN tf USING (priority)
    )
    SELECT {_SCORE_COLUMNS_SQL} FROM adjusted WHERE w >= 0.5
    """,
)
def tf_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _registers(spark, sf_dir)
    return _rounded(
        predict(left, right, "id", [block_on("customer")], _fixed_model(tf=True), 0.5)
    )


@query(
    "link_best_match",
    f"""
    {_SCORED_SQL}
    SELECT {_SCORE_COLUMNS_SQL} FROM scored WHERE w >= 0.5
    QUALIFY row_number() OVER (PARTITION BY id_l ORDER BY w DESC, id_r) = 1
    """,
)
def link_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _registers(spark, sf_dir)
    scored = predict(left, right, "id", [block_on("customer")], _fixed_model(tf=False), 0.5)
    return _rounded(best_match(scored, "id_l", "match_weight", ["id_r"]))


@query(
    "deterministic_prior",
    f"""
    WITH {_REGISTERS_SQL}
    SELECT CAST(count(*) AS DOUBLE) AS pairs FROM l JOIN r ON l.customer = r.customer
    WHERE l.priority = r.priority OR (l.yr = r.yr AND l.mon = r.mon)
       OR (l.yr = r.yr AND l.status = r.status)
    """,
)
def deterministic_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _registers(spark, sf_dir)
    return deterministic_pairs(left, right, [*_RULES, ("customer", "yr", "status")])


def _level_shares_sql(name: str, highest: int) -> str:
    return f"""
        SELECT '{name}' AS comparison, CAST(level AS INTEGER) AS gamma,
               greatest(count(*) FILTER (gamma_{name} = level)
                        / CAST(count(*) FILTER (gamma_{name} >= 0) AS DOUBLE), 1e-12) AS u
        FROM g, range({highest + 1}) AS levels(level) GROUP BY level
    """


_U_SQL = f"""
    WITH {_REGISTERS_SQL},
    size AS (
        SELECT CAST(greatest(1, ceil((SELECT count(*) FROM l) * (SELECT count(*) FROM r) / 1e7))
                    AS BIGINT) AS buckets
    ),
    ls AS (SELECT *, CAST('0x' || substr(md5('123|' || id), 1, 15) AS BIGINT) % buckets AS bucket
           FROM l, size),
    rs AS (SELECT *, CAST('0x' || substr(md5('123|' || id), 1, 15) AS BIGINT) % buckets AS bucket
           FROM r, size),
    g AS (SELECT {_GAMMA_SQL} FROM ls AS l JOIN rs AS r ON l.bucket = r.bucket),
    shares AS (
        {_level_shares_sql("price", 3)} UNION ALL {_level_shares_sql("day", 3)}
        UNION ALL {_level_shares_sql("priority", 1)} UNION ALL {_level_shares_sql("season", 2)}
    )
"""


@query("u_sample", f"{_U_SQL} SELECT comparison, gamma, u FROM shares")
def u_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level shares among random pairs."""
    left, right = _registers(spark, sf_dir)
    model = starting_model(_comparisons())
    model = estimate_u(model, random_pairs(left, right, "id"))
    return spark.createDataFrame(
        parameters(model), "comparison string, gamma int, m double, u double"
    ).select("comparison", "gamma", "u")


@query(
    "fixed_levels",
    f"""{_U_SQL}
    SELECT comparison, gamma,
           CASE WHEN comparison = 'day' AND gamma = 3 THEN 0.0001 ELSE u END AS u
    FROM shares
    """,
)
def fixed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated level shares where one level keeps a given value."""
    left, right = _registers(spark, sf_dir)
    price, _, *others = _comparisons()
    day = lv.compare(
        "day",
        lv.null_level("day"),
        lv.exact("day").with_fixed(0.9999, 0.0001),
        lv.within_difference("day", 7),
        lv.within_difference("day", 90),
        lv.otherwise(),
    )
    model = starting_model((price, day, *others))
    model = estimate_u(model, random_pairs(left, right, "id"))
    return spark.createDataFrame(
        parameters(model), "comparison string, gamma int, m double, u double"
    ).select("comparison", "gamma", "u")


_LEVELS = {"price": 3, "day": 3, "priority": 1, "season": 2}
_TRAINING = {"by_priority": ("l.priority = r.priority", ("price", "day", "season")),
             "by_year": ("l.yr = r.yr", ("price", "day", "priority"))}


def _em_sql(run: str) -> str:
    """Patterns of one training rule and EM as a recursive query over them."""
    condition, free = _TRAINING[run]
    cells = [(c, g) for c in free for g in range(_LEVELS[c], -1, -1)]

    def at_level(c: str, value: str) -> str:
        cases = " ".join(f"WHEN {g} THEN {value.format(c=c, g=g)}" for g in range(_LEVELS[c] + 1))
        return f"CASE gamma_{c} {cases} ELSE 1.0 END"

    starts = ", ".join(
        f"{0.95 if g == _LEVELS[c] else 0.05 / _LEVELS[c]!r}::DOUBLE AS m_{c}_{g}" for c, g in cells
    )
    old = ", ".join(f"any_value(m_{c}_{g}) AS old_{c}_{g}" for c, g in cells)
    new = ", ".join(
        f"""greatest(coalesce(sum(match) FILTER (gamma_{c} = {g}), 0)
            / sum(match) FILTER (gamma_{c} >= 0), 1e-12) AS m_{c}_{g}"""
        for c, g in cells
    )
    names = ", ".join(f"m_{c}_{g}" for c, g in cells)
    moved = ", ".join(f"abs(m_{c}_{g} - old_{c}_{g})" for c, g in cells)
    like_m = " * ".join(at_level(c, "greatest(m_{c}_{g}, 1e-12)") for c in free)
    like_u = " * ".join(
        at_level(c, "greatest((SELECT u FROM shares WHERE comparison = '{c}' AND gamma = {g}), 1e-12)")
        for c in free
    )
    gammas = ", ".join(f"gamma_{c}" for c in free)
    return f"""
    patterns_{run} AS MATERIALIZED (
        SELECT *, {like_u} AS like_u FROM (
            SELECT {gammas}, count(*)::DOUBLE AS n
            FROM (SELECT {_GAMMA_SQL} FROM l JOIN r ON l.customer = r.customer AND {condition})
            GROUP BY ALL)
    ),
    em_{run} AS (
        SELECT 0 AS step, greatest((SELECT prior FROM start), 1e-6) AS prior, {starts},
               1.0::DOUBLE AS change
        UNION ALL
        SELECT step, prior, {names}, greatest({moved})
        FROM (
            SELECT any_value(step) + 1 AS step, {old}, {new},
                   least(greatest(sum(match) / sum(n), 1e-12), 1 - 1e-12) AS prior
            FROM (SELECT *, n * prior * {like_m}
                         / (prior * {like_m} + (1 - prior) * like_u) AS match
                  FROM em_{run}, patterns_{run} WHERE change >= 1e-6)
        ) WHERE step IS NOT NULL
    ),
    done_{run} AS (
        UNPIVOT (SELECT {names} FROM em_{run} ORDER BY step DESC LIMIT 1)
        ON {names} INTO NAME cell VALUE m
    )"""


@query(
    "em_model",
    f"""
    {_U_SQL.replace("WITH", "WITH RECURSIVE", 1)},
    start AS (
        SELECT least(greatest((SELECT count(*) FROM l JOIN r ON l.customer = r.customer
                                 AND l.yr = r.yr AND l.mon = r.mon) / 0.7
                              / ((SELECT count(*) FROM l) * (SELECT count(*) FROM r)), 1e-12),
                     1 - 1e-12) AS prior
    ),
    {_em_sql("by_priority")},
    {_em_sql("by_year")},
    trained AS (
        SELECT cell, median(m) AS m
        FROM (SELECT * FROM done_by_priority UNION ALL SELECT * FROM done_by_year) GROUP BY cell
    )
    SELECT comparison, gamma, round(m, 5) AS m, u
    FROM shares JOIN trained ON cell = 'm_' || comparison || '_' || gamma
    """,
)
def em_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole training: prior, u, EM per rule until no level moves, combined."""
    left, right = _registers(spark, sf_dir)
    model = fit(
        _comparisons(),
        left,
        right,
        "id",
        prior_rules=[("customer", "yr", "mon")],
        recall=0.7,
        training_rules=[block_on("customer", "priority"), block_on("customer", "yr")],
    )
    return spark.createDataFrame(
        parameters(model), "comparison string, gamma int, m double, u double"
    ).withColumn("m", F.round("m", 5))


# --- links by text, by several rules, clusters and matchings --------------------------

_PAGE_SQL = """
    SELECT page_id AS id, url, split_part(split_part(url, '://', 2), '/', 1) AS host,
           regexp_extract(url, '://[^/?#]*[.]([a-z]+)', 1) AS domain, length(html) AS size
    FROM pages
"""
_TEXT_PRIOR = 0.0005
_TEXT_FIXED = {
    "url": {3: (0.5, 0.0001), 2: (0.3, 0.0005), 1: (0.15, 0.02), 0: (0.05, 0.9794)},
    "size": {1: (0.7, 0.05), 0: (0.3, 0.95)},
}


def _page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        "url",
        F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"),
        F.regexp_extract("url", "://[^/?#]*[.]([a-z]+)", 1).alias("domain"),
        F.length("html").cast("long").alias("size"),
    )


_TEXT_SCORED_SQL = f"""
    WITH p AS ({_PAGE_SQL}),
    g AS (
        SELECT l.id AS id_l, r.id AS id_r,
               CASE WHEN l.url = r.url THEN 3 WHEN jaro_winkler_similarity(l.url, r.url) >= 0.98 THEN 2
                    WHEN jaro_winkler_similarity(l.url, r.url) >= 0.95 THEN 1 ELSE 0 END AS gamma_url,
               CASE WHEN greatest(l.size, r.size) > 0
                     AND abs(l.size - r.size) / greatest(l.size, r.size) < 0.05 THEN 1
                    ELSE 0 END AS gamma_size
        FROM p l JOIN p r ON l.domain = r.domain AND l.id < r.id
    ),
    scored AS (
        SELECT *, CAST({repr(math.log2(_TEXT_PRIOR / (1 - _TEXT_PRIOR)))} + {" + ".join(
            f"CASE gamma_{n} " + " ".join(
                f"WHEN {g} THEN {math.log2(m / u)!r}" for g, (m, u) in by.items()) + " END"
            for n, by in _TEXT_FIXED.items())} AS DOUBLE) AS w FROM g
    )
"""


@query(
    "predict_text",
    f"{_TEXT_SCORED_SQL} SELECT id_l, id_r, round(w, 6) AS match_weight FROM scored WHERE w >= -5",
)
def predict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide blocks in which only similar text can make a pair: a search by letters finds them."""
    pages = stage(_page_records(spark, sf_dir), "records")  # read often, with the html else
    comparisons = (
        lv.compare(
            "url",
            lv.null_level("url"),
            lv.exact("url"),
            lv.similar("url", 0.98),
            lv.similar("url", 0.95),
            lv.otherwise(),
        ),
        lv.compare("size", lv.null_level("size"), lv.within_share("size", 0.05), lv.otherwise()),
    )
    model = Model(
        comparisons,
        _TEXT_PRIOR,
        {n: {g: m for g, (m, _) in by.items()} for n, by in _TEXT_FIXED.items()},
        {n: {g: u for g, (_, u) in by.items()} for n, by in _TEXT_FIXED.items()},
    )
    found = predict(pages, None, "id", [block_on("domain")], model, -5.0)
    return found.select("id_l", "id_r", F.round("match_weight", 6).alias("match_weight"))


@query(
    "predict_rules",
    f"""
    WITH {_REGISTERS_SQL},
    g AS (
        SELECT l.id AS id_l, r.id AS id_r, {_GAMMA_SQL},
               CAST(CASE WHEN l.customer = r.customer THEN 0 ELSE 1 END AS INTEGER) AS match_key
        FROM l JOIN r ON l.customer = r.customer OR (l.yr = r.yr AND l.mon = r.mon)
    ),
    scored AS (SELECT *, CAST({_weight_sql()} AS DOUBLE) AS w FROM g)
    SELECT {_SCORE_COLUMNS_SQL}, match_key FROM scored WHERE w >= 5
    """,
)
def predict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules, one of narrow and one of wide blocks; each forms pairs the cheaper way."""
    left, right = _registers(spark, sf_dir)
    rules, model = [block_on("customer"), block_on("yr", "mon")], _fixed_model(tf=False)
    found = predict(left, right, "id", rules, model, 5.0)
    return _rounded_by_pattern(found, model, 5.0, "match_key")


@query(
    "link_clusters",
    f"""
    {_SCORED_SQL.replace("WITH", "WITH RECURSIVE", 1)},
    edges AS (
        SELECT id_l AS a, id_r AS b FROM scored WHERE w >= 2
        UNION ALL SELECT id_r, id_l FROM scored WHERE w >= 2
    ),
    reach AS (
        SELECT id, id AS root FROM rec UNION SELECT b, root FROM reach JOIN edges ON a = id
    )
    SELECT id, min(root) AS cluster FROM reach GROUP BY id
    """,
)
def link_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders grouped by links of some weight; most stand alone."""
    left, right = _registers(spark, sf_dir)
    scored = predict(left, right, "id", [block_on("customer")], _fixed_model(tf=False), 0.5)
    return clusters(scored, "id", "match_weight", 2.0, _records(spark, sf_dir))


@query(
    "one_to_one_matching",
    f"""
    {_SCORED_SQL.replace("WITH", "WITH RECURSIVE", 1)},
    rounds AS (
        SELECT 0 AS step, id_l, id_r, round(w, 6) AS w, false AS taken FROM scored WHERE w >= 0.5
        UNION ALL
        SELECT step, id_l, id_r, w, best FROM (
            SELECT *, bool_or(best) OVER (PARTITION BY id_l) OR bool_or(best) OVER (PARTITION BY id_r)
                      AS gone
            FROM (
                SELECT step + 1 AS step, id_l, id_r, w,
                       row_number() OVER (PARTITION BY id_l ORDER BY w DESC, id_r) = 1
                       AND row_number() OVER (PARTITION BY id_r ORDER BY w DESC, id_l) = 1 AS best
                FROM rounds WHERE NOT taken
            )
        ) WHERE best OR NOT gone
    )
    SELECT id_l, id_r, w AS match_weight FROM rounds WHERE taken
    """,
)
def one_to_one_matching_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order in one link at most, heaviest links first."""
    left, right = _registers(spark, sf_dir)
    scored = predict(left, right, "id", [block_on("customer")], _fixed_model(tf=False), 0.5)
    scored = scored.withColumn("match_weight", F.round("match_weight", 6))
    return one_to_one_matching(scored, "id_l", "id_r", "match_weight")


# --- pairwise similarities ------------------------------------------------------------


@query(
    "jaro_winkler_pairs",
    """
    SELECT a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 9) AS name_similarity,
           round(jaro_winkler_similarity(a.p_type, b.p_name), 9) AS type_similarity
    FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
    """,
)
def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    after = part.select(
        (F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name")
    )
    return part.join(after, "p_partkey").select(
        "p_partkey",
        F.round(jaro_winkler(F.col("p_name"), F.col("next_name")), 9).alias("name_similarity"),
        F.round(jaro_winkler(F.col("p_type"), F.col("next_name")), 9).alias("type_similarity"),
    )


@query(
    "jaro_winkler_urls",
    """
    SELECT a.page_id, round(jaro_winkler_similarity(a.url, b.url), 9) AS similarity
    FROM pages a JOIN pages b ON b.page_id = a.page_id + 1
    """,
)
def jaro_winkler_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return pages.join(after, "page_id").select(
        "page_id", F.round(jaro_winkler(F.col("url"), F.col("next_url")), 9).alias("similarity")
    )


@query(
    "vector_cosine",
    """
    SELECT a.vec_id, round(list_cosine_similarity(
        CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    """,
)
def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    after = vectors.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding")
    )
    return vectors.join(after, "vec_id").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("next_embedding")), 9).alias("similarity")
    )


# Customers and suppliers get coordinates and a nation; pairs lie within 150 km.
_PLACE = "40 + (({k} * 7919) % 2000) / 100.0 AS lat, (({k} * 104729) % 3000) / 100.0 AS lon"
_KM_SQL = """2 * 6371.0 * asin(sqrt(least(1.0,
    pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat))
        * pow(sin(radians(b.lon - a.lon) / 2), 2))))"""


@query(
    "haversine_pairs",
    f"""
    WITH a AS (SELECT c_custkey AS id, c_nationkey AS nation, {_PLACE.format(k="c_custkey")}
               FROM customer),
    b AS (SELECT s_suppkey AS id, s_nationkey AS nation, {_PLACE.format(k="s_suppkey")}
          FROM supplier)
    SELECT a.id AS id_l, b.id AS id_r, round({_KM_SQL}, 6) AS km
    FROM a JOIN b ON a.nation = b.nation WHERE {_KM_SQL} <= 150
    """,
)
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close pairs through grid cells: far pairs are never formed."""

    def placed(name: str, key: str, nation: str) -> DataFrame:
        k = F.col(key)
        return table(spark, sf_dir, name).select(
            k.alias("id"),
            F.col(nation).alias("nation"),
            (40 + (k * 7919) % 2000 / 100.0).alias("lat"),
            ((k * 104729) % 3000 / 100.0).alias("lon"),
        )

    close = lv.within_km("lat", "lon", 150.0)
    pairs = indexed_pairs(
        placed("customer", "c_custkey", "c_nationkey"),
        placed("supplier", "s_suppkey", "s_nationkey"),
        "id",
        block_on("nation"),
        [close],
    ).where(close.condition)
    km = distance_km(F.col("lat_l"), F.col("lon_l"), F.col("lat_r"), F.col("lon_r"))
    return pairs.select("id_l", "id_r", F.round(km, 6).alias("km"))


@query(
    "pct_diff_levels",
    f"""
    WITH {_REGISTERS_SQL}
    SELECT l.id AS id_l, r.id AS id_r,
           CAST(CASE WHEN abs(l.price - r.price) / greatest(l.price, r.price) < 0.01 THEN 2
                     ELSE 1 END AS INTEGER) AS gamma_price
    FROM l JOIN r ON l.customer = r.customer
    WHERE abs(l.price - r.price) / greatest(l.price, r.price) < 0.05
    """,
)
def pct_diff_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices within 5 % through logarithmic buckets."""
    left, right = _registers(spark, sf_dir)
    comparison = lv.compare(
        "price", lv.within_share("price", 0.01), lv.within_share("price", 0.05), lv.otherwise()
    )
    pairs = indexed_pairs(left, right, "id", block_on("customer"), [comparison.levels[1]])
    graded = lv.with_gammas(pairs, [comparison]).where("gamma_price > 0")
    return graded.select("id_l", "id_r", "gamma_price")
