"""Anomaly and repair operators: hand-worked cases, quantiles and injected errors."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.operators import anomaly, quantile, repair

SCHEMA = "id string, year int, v double"


def series(spark, *values, unit="A"):
    return spark.createDataFrame(
        [(unit, 2000 + i, None if v is None else float(v)) for i, v in enumerate(values)], SCHEMA
    )


def repaired(df, **kwargs):
    result = anomaly.repair_units(df, "v", ["id"], "year", **kwargs)
    return [r.v for r in result.orderBy("year").collect()]


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ((10, 10000, 11), [10.0, 10.0, 11.0]),
        ((10000, 10, 12000), [10000.0, 10000.0, 12000.0]),
        # A spike below the threshold, at the edge of the series, or that stays, is genuine.
        ((10, 8000, 12), [10.0, 8000.0, 12.0]),
        ((10000, 10, 12), [10000.0, 10.0, 12.0]),
        ((10, 10000, 12000), [10.0, 10000.0, 12000.0]),
        ((10, 0, 12), [10.0, 0.0, 12.0]),
        ((10, None, 12), [10.0, None, 12.0]),
        ((7,), [7.0]),
    ],
)
def test_repair_units(spark, values, expected):
    assert repaired(series(spark, *values)) == pytest.approx(expected)


def test_flags_are_never_missing(spark):
    flagged = anomaly.flag_jumps(series(spark, 1, None, 3), "v", ["id"], "year")
    assert [r.is_jump for r in flagged.orderBy("year").collect()] == [False, False, False]


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.floats(min_value=1e-12, max_value=1e15, allow_nan=False), min_size=1, max_size=40
    ),
    st.sampled_from([0.0, 0.05, 0.5, 0.95, 0.99, 1.0]),
)
def test_quantiles_match_numpy(spark, values, q):
    df = spark.createDataFrame([("g", v) for v in [*values, -1.0, 0.0]], "g string, v double")
    got = quantile.positive_quantiles(df, "v", ["g"], {"q": q}).first().q
    assert got == pytest.approx(np.quantile(np.array(values), q), rel=1e-9)


def test_quantiles_exact_on_repeats_and_close_values(spark):
    close = [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 2), 2.0, 0.1, 0.3]
    data = [("a", float(v)) for v in close] + [(None, 5.0)] * 9 + [(None, 7.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {
        r.g: (r.lo, r.mid)
        for r in quantile.positive_quantiles(df, "v", ["g"], {"lo": 0.0, "mid": 0.6}).collect()
    }
    assert got["a"] == (0.1, float(np.nextafter(1.0, 2)))
    assert got[None] == (5.0, 5.0)


def test_drop_ambiguous_counts_values_only(spark):
    df = spark.createDataFrame(
        [("A", 1, 1.0), ("A", 1, 2.0), ("B", 1, 1.0), ("B", 1, None), (None, 1, 1.0), (None, 1, 3.0)],
        SCHEMA,
    )
    kept = anomaly.drop_ambiguous(df, "v", ["id", "year"])
    assert sorted(r.id for r in kept.collect()) == ["B", "B"]


def test_paired_series(spark):
    data = []
    for year, whole, part in ((1, 100, 100), (2, 1000, 100), (3, 110, 110), (4, 120, 120)):
        data += [("A", year, "CO2", "AIR", float(whole)), ("A", year, "CO2EXCLBIOMASS", "AIR", float(part))]
    df = spark.createDataFrame(
        data,
        "Facility_INSPIRE_ID string, reportingYear int, pollutantCode string, medium string, "
        "totalPollutantQuantityKg double",
    )
    voided = repair.void_biomass_errors(df).where("totalPollutantQuantityKg IS NULL").collect()
    assert [(r.reportingYear, r.pollutantCode) for r in voided] == [(2, "CO2")]


def releases(spark, wrong):
    """Three proxies that follow CO2; the given (facility, year) cells are off by a factor."""
    random.seed(5)
    data = []
    for i in range(20):
        level = 10 ** random.uniform(5, 7)
        for year in range(2007, 2018):
            co2 = level * random.uniform(0.9, 1.1)
            factor = wrong.get((f"F{i}", year), 1.0)
            data.append((f"F{i}", year, "CO2", "AIR", co2 * factor))
            for code, share in (("NOX", 0.01), ("SOX", 0.02), ("PM10", 0.001)):
                data.append((f"F{i}", year, code, "AIR", co2 * share * random.uniform(0.95, 1.05)))
    return spark.createDataFrame(
        data,
        "Facility_INSPIRE_ID string, reportingYear long, pollutantCode string, medium string, "
        "totalPollutantQuantityKg double",
    )


def test_injected_release_errors_are_repaired_and_nothing_else(spark):
    # kg given as tonnes, three wrong years in a row, and one year too high.
    # At most one per year: a second one would pull the band of its 20 peers along.
    wrong = {("F1", 2010): 1e-3, ("F3", 2016): 1e3}
    # A ratio is floored at 1/20 of its median, so values that are too high move by one
    # power of ten only.
    left_over = {("F3", 2016): 1e2}
    wrong |= {("F2", year): 0.1 for year in (2012, 2013, 2014)}
    broken = releases(spark, wrong)
    truth = {
        (r.Facility_INSPIRE_ID, r.reportingYear): r.totalPollutantQuantityKg
        for r in releases(spark, {}).where("pollutantCode = 'CO2'").collect()
    }
    fixed = repair.repair_releases(broken).where("pollutantCode = 'CO2'").collect()
    assert len(fixed) == len(truth)
    for r in fixed:
        key = (r.Facility_INSPIRE_ID, r.reportingYear)
        expected = truth[key] * left_over.get(key, 1.0)
        assert r.totalPollutantQuantityKg == pytest.approx(expected, rel=1e-9), key


def energy(spark, wrong):
    random.seed(7)
    fuel_rows, emission_rows = [], []
    for i in range(15):
        level = 10 ** random.uniform(2.5, 4)
        for year in range(2008, 2020):
            tj = level * random.uniform(0.9, 1.1)
            for fuel, share in (("Coal", 0.7), ("NaturalGas", 0.3)):
                value = wrong.get((f"P{i}", year, fuel), lambda v: v)(tj * share)
                fuel_rows.append((f"P{i}", year, fuel, None, None, value))
            for code, share in (("NOX", 0.1), ("SO2", 0.2), ("DUST", 0.01)):
                emission_rows.append((f"P{i}", year, code, tj * share * random.uniform(0.97, 1.03)))
    fuels = spark.createDataFrame(
        fuel_rows,
        "Installation_Part_INSPIRE_ID string, reportingYear long, fuelInputCode string, "
        "otherSolidFuelCode string, otherGaseousFuelCode string, energyInputTJ double",
    )
    emissions = spark.createDataFrame(
        emission_rows,
        "Installation_Part_INSPIRE_ID string, reportingYear long, pollutantCode string, "
        "totalPollutantQuantityTNE double",
    )
    return fuels, emissions


def test_injected_energy_errors(spark):
    wrong = {
        ("P1", 2013, "Coal"): lambda v: v * 1000,
        ("P2", 2014, "Coal"): lambda v: v / 1000,
        ("P3", 2015, "Coal"): lambda v: 0.0,
        ("P4", 2013, "Coal"): lambda v: v * 10,
    }
    truth, _ = energy(spark, {})
    broken, emissions = energy(spark, wrong)
    keys = ["Installation_Part_INSPIRE_ID", "reportingYear", "fuelInputCode"]
    fixed = repair.repair_energy(broken, emissions)
    joined = fixed.join(
        truth.select(*keys, F.col("energyInputTJ").alias("true_tj")), keys
    ).collect()
    assert len(joined) == truth.count()
    for r in joined:
        key = (r.Installation_Part_INSPIRE_ID, r.reportingYear, r.fuelInputCode)
        if key == ("P3", 2015, "Coal"):
            assert r.energyInputTJ in (None, 0.0)
        else:
            assert r.energyInputTJ == pytest.approx(r.true_tj, rel=1e-9), key


def test_audit(spark):
    raw = series(spark, 1, 2, 3)
    after = raw.withColumn("v", F.when(F.col("year") == 2000, None).when(F.col("year") == 2001, 9.0).otherwise(F.col("v")))
    audit = repair.audit_repair(raw, after, ["id", "year"], "v")
    got = {r.year: (r.is_changed, r.is_voided) for r in audit.collect()}
    assert got == {2000: (False, True), 2001: (True, False), 2002: (False, False)}
