"""Three-valued NOT IN, crosswalk and version operators against brute force."""

import itertools

import duckdb
import pytest

from panelforge.operators import crosswalk, joins, versions

VALUES = [None, 1, 2]
PAIRS = list(itertools.product(VALUES, VALUES))


@pytest.mark.parametrize(
    "listed",
    [
        [],
        [(1, 1)],
        [(1, 1), (2, 2)],
        [(None, 1)],
        [(1, None)],
        [(None, None)],
        [(1, 2), (None, 2)],
        [(2, None), (1, 1)],
    ],
)
def test_rows_not_listed_follows_sql(spark, listed):
    candidates = spark.createDataFrame(PAIRS, "u int, t int")
    given = spark.createDataFrame(listed, "u int, t int")
    got = sorted(map(str, (tuple(r) for r in joins.rows_not_listed(candidates, given, "u", "t").collect())))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE c (u INT, t INT)")
    connection.execute("CREATE TABLE l (u INT, t INT)")
    connection.executemany("INSERT INTO c VALUES (?, ?)", PAIRS)
    if listed:
        connection.executemany("INSERT INTO l VALUES (?, ?)", listed)
    # Spelled out: no listed pair may be equal or of unknown equality.
    expected = connection.sql(
        """
        SELECT u, t FROM c WHERE NOT EXISTS (
            SELECT 1 FROM l WHERE coalesce(l.u = c.u, TRUE) AND coalesce(l.t = c.t, TRUE))
        """
    ).fetchall()
    assert got == sorted(map(str, expected))


def test_crosswalk_applies_once_and_falls_back(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    mapping = spark.createDataFrame([("x", "a"), ("x", "a")], "id_cluster string, id string")
    got = crosswalk.apply_crosswalk(df, mapping, "id").collect()
    assert sorted((r.n, r.id) for r in got) == [(1, "x"), (2, "b"), (3, None)]


def test_one_to_one_drops_chains(spark):
    df = spark.createDataFrame(
        [("b", "a"), ("c", "b"), ("e", "d"), (None, "f")], "cluster string, member string"
    )
    got = crosswalk.enforce_one_to_one(df, "member", "cluster").collect()
    assert sorted(r.member for r in got) == ["a", "d", "f"]


def test_edges_to_unlinked(spark):
    df = spark.createDataFrame(
        [
            ("p", "q", None, "F1", 2.0),
            ("p", "r", None, "F2", 5.0),
            ("s", "p", "F3", None, 4.0),
            ("q", "r", "F1", "F2", 9.0),
            ("p", "t", None, None, 9.0),
        ],
        "id_l string, id_r string, k_l string, k_r string, w double",
    )
    got = crosswalk.edges_to_unlinked(df, "id", "k", "w").collect()
    assert [tuple(r) for r in got] == [("p", "F2", 5.0)]


def test_latest_per_key_treats_missing_order_as_last(spark):
    df = spark.createDataFrame(
        [("a", 1, "old"), ("a", None, "undated"), ("a", 2, "new"), ("b", 1, None)],
        "k string, o int, v string",
    )
    got = versions.latest_per_key(df, ["k"], ["o"]).collect()
    assert sorted((r.k, r.v) for r in got) == [("a", "undated"), ("b", None)]


def test_versions_are_stacked_in_order(spark):
    def load(session, version):
        return session.createDataFrame([(1, version + "!")], "fileId_EUReg int, v string")

    def metadata(session, version):
        return session.createDataFrame([(1, None, 2020)], "fileId int, dateSubmitted date, reportingYear int")

    got = versions.stack_versions(spark, load, metadata, ["reportingYear"], ["v1", "v2", "v10"])
    assert [tuple(r) for r in got.collect()] == [(2020, "v10!")]


def test_melt_and_union(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "id string, x double, y double")
    long = joins.melt(df, ["id"], ["x", "y"], "name", "value").collect()
    assert sorted(tuple(r) for r in long) == [("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 3.0)]
    more = spark.createDataFrame([(3.0, "b"), (3.0, "b")], "y double, id string")
    assert joins.union_distinct_by_name(df, more).count() == 3
