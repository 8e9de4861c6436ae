"""Text normalising and similarity against an independent implementation."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from panelforge.functions import text as names
from panelforge.functions.ordered import first_non_null, first_value, last_value
from panelforge.functions.similarity import _jaro_winkler, cosine, jaro_winkler

NAMES = [
    "Kraftwerk Müller GmbH & Co. KG",
    "  ÉLECTRICITÉ de France, S.A.  ",
    "Łódź Ąę ß ø Ελλάδα",
    "Централа",
    "a_b-c  d",
    "",
    None,
    "…!?",
    "Müller",
    "Čez, a.s.",
]


def test_clean_matches_sql(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "i int, n string")
    got = [r.c for r in df.select("i", names.clean("n").alias("c")).orderBy("i").collect()]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (i INT, n VARCHAR)")
    connection.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(NAMES)))
    expected = connection.sql(
        r"""SELECT nullif(trim(trim(regexp_replace(lower(strip_accents(n)), '[^\w\s]', '', 'g'))), '')
        FROM t ORDER BY i"""
    ).fetchall()
    assert got == [r[0] for r in expected]


def test_clean_removes_other_columns(spark):
    df = spark.createDataFrame(
        [("Müller Kraftwerk Köln", "Köln", None), ("Werk köln", "köln", None)],
        "n string, city string, none string",
    )
    got = df.select(names.clean("n", remove=["city", "none", F.lit("Kraftwerk")]).alias("c"))
    # Only the name itself loses its accents, not what is cut from it.
    assert [r.c for r in got.collect()] == ["muller  koln", "werk koln"]


def test_stop_words_and_stripping(spark):
    codes = spark.createDataFrame(
        [("GmbH;Gesellschaft mit b.H.", "AG"), (None, "S.A.")], "local string, short string"
    )
    words = {r.word for r in names.stop_words(codes, ["local", "short"]).collect()}
    assert words == {"gmbh", "gesellschaft", "mit", "bh", "ag", "sa"}
    df = spark.createDataFrame(
        [(1, "muller gmbh werk", "ag"), (2, "sa gmbh", None), (3, None, "x  y")],
        "unique_id int, a string, b string",
    )
    stop_list = spark.createDataFrame([(w,) for w in words], "word string")
    got = names.strip_stop_words(df, stop_list, ["a", "b"]).orderBy("unique_id")
    assert [tuple(r) for r in got.collect()] == [
        (1, "muller werk", None),
        (2, None, None),
        (3, None, "x  y"),
    ]


def test_stripping_needs_no_ids_and_takes_lists_of_any_length(spark):
    rows = [
        (None, "the mill, The end", "x"),
        (None, "of the", None),
        (1, "", "the-the"),
        (1, "a  b " * 5000 + "o.f", "of"),
    ]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    stop_list = spark.createDataFrame([("the",), ("of",), (None,), ("thethe",)], "word string")
    wanted = [
        (None, "mill, The end", "x"),
        (None, None, None),
        (1, None, None),
        (1, ("a  b " * 5000)[:-1], None),
    ]
    for literal_words in (10, 1):  # one projection, then the join
        got = names.strip_stop_words(df, stop_list, ["a", "b"], literal_words)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
        assert got.columns == df.columns
    plan = names.strip_stop_words(df, stop_list, ["a"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "INSET" in plan.upper() or " IN " in plan
    none = names.strip_stop_words(df, stop_list.limit(0), ["a", "b"])
    assert none.where("a = ''").count() == 0


def test_jaro_winkler_matches_sql(spark):
    words = ["martha", "marhta", "dixon", "dicksonx", "", "a", "ab", "müller", "mueller",
             "kraftwerk nord", "kraftwerk süd", "central", "centrale", "abcdefgh", "hgfedcba"]
    pairs = [(a, b) for a in words for b in words] + [(None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.s for r in df.select(jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (i INT, a VARCHAR, b VARCHAR)")
    connection.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, *p) for i, p in enumerate(pairs)])
    expected = [
        r[0]
        for r in connection.sql(
            "SELECT jaro_winkler_similarity(a, b) FROM t ORDER BY i"
        ).fetchall()
    ]
    for pair, mine, theirs in zip(pairs, got, expected, strict=True):
        assert mine == pytest.approx(theirs, abs=1e-12), pair


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>"
    )
    got = [r.s for r in df.select(cosine(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [pytest.approx(0.5**0.5), None]


def test_ordered_aggregates(spark):
    df = spark.createDataFrame(
        [(1, "x"), (2, None), (None, "z"), (3, "y")], "k int, v string"
    )
    row = df.agg(
        first_value("v", "k").alias("first"),
        last_value("v", "k").alias("last"),
        first_non_null("v", F.when(F.col("k") > 1, F.col("k"))).alias("known"),
    ).first()
    assert (row["first"], row["last"], row["known"]) == ("x", "z", "y")


def test_short_texts_are_matched_together_as_one_by_one(spark):
    rng = random.Random(7)
    some = ["".join(rng.choices("abcé\0z/1", k=rng.choice([1, 2, 4, 9, 40, 63, 64, 65, 90]))) for _ in range(60)]
    some += ["", "a", None, "a" * 64]
    changed = [t if not t else t[: len(t) // 2] + rng.choice("ab") + t[len(t) // 2 + 1 :] for t in some]
    pairs = [(a, b) for a in some for b in [*rng.sample(some, 20), rng.choice(changed), a]]
    pairs += list(zip(some, changed, strict=True))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", jaro_winkler(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    want = [None if None in p else _jaro_winkler(p[0].encode(), p[1].encode()) for p in pairs]
    assert [r.s for r in got] == want
