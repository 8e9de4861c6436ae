"""Panel operators on hand-worked cases."""

import math
import random
import pytest
from pyspark.sql import functions as F

from panelforge.operators import panel

SCHEMA = "id string, year int, value double"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_balance_adds_missing_year(spark):
    df = spark.createDataFrame([("A", 2020, 1.0), ("A", 2022, 2.0)], SCHEMA)
    assert rows(panel.balance(df, "year", ["id"]), "year") == [
        ("A", 2020, 1.0),
        ("A", 2021, None),
        ("A", 2022, 2.0),
    ]


def test_balance_spans_all_groups(spark):
    df = spark.createDataFrame([("A", 2020, 1.0), ("B", 2022, 2.0)], SCHEMA)
    result = panel.balance(df, "year", ["id"])
    assert result.count() == 6
    assert {r.year for r in result.select("year").distinct().collect()} == {2020, 2021, 2022}


def test_balance_is_idempotent(spark):
    data = [("A", 2020, 1.0), ("A", 2021, 2.0), ("B", 2020, 3.0), ("B", 2021, 4.0)]
    once = panel.balance(spark.createDataFrame(data, SCHEMA), "year", ["id"])
    assert rows(once, "id", "year") == data
    assert rows(panel.balance(once, "year", ["id"]), "id", "year") == data


def test_balance_single_row(spark):
    df = spark.createDataFrame([("X", 2020, 1.0)], SCHEMA)
    assert rows(panel.balance(df, "year", ["id"]), "year") == [("X", 2020, 1.0)]


def test_balance_two_keys(spark):
    df = spark.createDataFrame(
        [("US", "NY", 2020, 1.0), ("US", "CA", 2021, 2.0), ("UK", "LN", 2020, 3.0)],
        "country string, city string, year int, value double",
    )
    assert panel.balance(df, "year", ["country", "city"]).count() == 6


def test_balance_keeps_missing_ids_repeats_and_drops_rows_without_time(spark):
    df = spark.createDataFrame(
        [(None, 2020, 1.0), ("A", 2021, 2.0), ("A", 2021, 3.0), ("A", None, 4.0), ("B", None, 5.0)],
        SCHEMA,
    )
    assert rows(panel.balance(df, "year", ["id"]), "id", "year", "value") == [
        (None, 2020, 1.0),
        (None, 2021, None),
        ("A", 2020, None),
        ("A", 2021, 2.0),
        ("A", 2021, 3.0),
        ("B", 2020, None),
        ("B", 2021, None),
    ]


SERIES = [("A", 1, None), ("A", 2, 10.0), ("A", 3, None), ("A", 4, None), ("A", 5, 40.0), ("A", 6, None)]


@pytest.mark.parametrize(
    ("direction", "expected"),
    [
        ("back", [10.0, 10.0, 40.0, 40.0, 40.0, None]),
        ("forward", [None, 10.0, 10.0, 10.0, 40.0, 40.0]),
        ("both", [10.0, 10.0, 40.0, 40.0, 40.0, 40.0]),
    ],
)
def test_fill(spark, direction, expected):
    df = spark.createDataFrame(SERIES, SCHEMA)
    filled = panel.fill_series(df, ["value"], ["id"], "year", direction)
    assert [r.value for r in filled.orderBy("year").collect()] == expected
    summarised = panel.fill_missing(df, {"value": F.col("value")}, ["id"], "year", direction)
    assert [r.value for r in summarised.orderBy("year").collect()] == expected


def test_fill_rejects_unknown_direction(spark):
    df = spark.createDataFrame(SERIES, SCHEMA)
    with pytest.raises(ValueError, match="Unknown direction"):
        panel.fill_series(df, ["value"], ["id"], "year", "sideways")
    with pytest.raises(ValueError, match="Unknown direction"):
        panel.fill_missing(df, {"value": F.col("value")}, ["id"], "year", "sideways")


def test_interpolate_stays_inside_gaps(spark):
    df = spark.createDataFrame(SERIES, SCHEMA)
    result = panel.interpolate(df, "value", ["id"], "year")
    values = [r.value for r in result.orderBy("year").collect()]
    assert values == [None, 10.0, 20.0, 30.0, 40.0, None]
    assert result.columns == df.columns


def test_fill_from_latest_never_reaches_back(spark):
    df = spark.createDataFrame(
        [("A", 2019, None), ("A", 2020, 1.0), ("A", 2021, 5.0), ("A", 2022, None)], SCHEMA
    )
    filled = panel.fill_from_latest(df, ["value"], ["id"], "year")
    assert [r.value for r in filled.orderBy("year").collect()] == [5.0, 1.0, 5.0, None]


def test_dense_vectors(spark):
    df = spark.createDataFrame(
        [
            ("A", 2007, "AIR", "CO2", 5.0),
            ("A", 2007, "AIR", "CO2", 7.0),
            ("A", 2008, "AIR", "NOX", 2.0),
            ("A", 2030, "AIR", "CO2", 9.0),
            ("B", 2007, "WATER", "ZN", 3.0),
        ],
        "id string, year int, medium string, code string, kg double",
    )
    result = panel.dense_vectors(
        df, "id", "year", ["medium", "code"], "kg", (2007, 2008), [("AIR", "NOX"), ("AIR", "CO2")]
    )
    assert rows(result, "id") == [
        ("A", [7.0, 0.0, 0.0, 2.0], 9.0),
        ("B", [0.0, 0.0, 0.0, 0.0], 0.0),
    ]


def test_dense_ids_have_no_gaps(spark):
    from panelforge.operators.numbering import with_dense_ids

    rng = random.Random(4)
    rows = [(rng.choice([None, *range(5)]), k) for k in range(2000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "a int, k long").repartition(7)
    got = with_dense_ids(frame, ["a", "k"], "n", first=0)
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r) for r in got.orderBy("n").collect()] == [(*r, n) for n, r in enumerate(wanted)]
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert with_dense_ids(frame.limit(0), ["a"], "n").count() == 0


def test_sketches_merge_and_keep_their_error(spark):
    from panelforge.operators.quantile_sketch import merge, sketch, sketch_quantiles

    rng = random.Random(8)
    values = [rng.lognormvariate(0, 4) for _ in range(3000)] + [float("inf")] * 2
    values += [0.0, -1.0, float("nan"), None]
    frame = spark.createDataFrame([(k % 2, k % 3, v) for k, v in enumerate(values)], "g int, p int, v double")
    for error in (0.01, 0.1):
        parts = [sketch(frame.where(F.col("p") == p), "v", ["g"], error) for p in range(3)]
        shares = {"low": 0.001, "mid": 0.5, "high": 0.99, "top": 1.0}
        got = sketch_quantiles(merge(parts), shares, error).collect()
        assert len(got) == 2
        for row in got:
            own = sorted(v for k, v in enumerate(values) if k % 2 == row.g and v is not None and v > 0)
            for name, q in shares.items():
                exact = own[max(1, math.ceil(q * len(own))) - 1]
                assert row[name] == exact or abs(row[name] - exact) <= exact * error * (1 + 1e-9)
