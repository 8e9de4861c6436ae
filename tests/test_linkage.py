"""Linkage stages against brute force, and invariants of the trained model."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.linkage import levels as lv
from panelforge.linkage.blocking import Rule, block_on, block_sizes, candidate_pairs, tiled_join
from panelforge.linkage.model import (
    Model,
    deterministic_pairs,
    estimate_prior,
    estimate_u,
    fit,
    random_pairs,
    starting_model,
    total_pairs,
    train_m,
)
from panelforge.functions.similarity import _jaro_winkler, letter_order
from panelforge.linkage import score as scoring
from panelforge.linkage import text_search
from panelforge.linkage.blocking import range_join
from panelforge.linkage.clusters import clusters
from panelforge.linkage.score import (
    KeyIndex,
    index_levels,
    indexed_pairs,
    possible,
    predict,
    score,
)
from panelforge.operators.crosswalk import best_by_weight, one_to_one_matching


def people(spark, n=120, seed=3, shift=0):
    """Records with one hot block, missing values and near duplicates."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        country = "DE" if rng.random() < 0.6 else rng.choice(["FR", "ES", None])
        name = rng.choice(["nordwerk", "nordwerke", "suedwerk", "central", "centrale", None])
        size = rng.choice([None, 1.0, 10.0, 10.4, 11.0, 100.0, 0.0])
        lat = None if rng.random() < 0.1 else 50 + rng.random()
        lon = None if rng.random() < 0.1 else 8 + rng.random()
        data.append((f"r{i + shift:04d}", country, name, size, rng.randint(1990, 1999), lat, lon))
    schema = "id string, country string, name string, size double, year int, lat double, lon double"
    return spark.createDataFrame(data, schema)


def ids(df):
    return sorted((r.id_l, r.id_r) for r in df.select("id_l", "id_r").collect())


@pytest.mark.parametrize("tile_rows", [1, 4, 1000])
def test_tiles_lose_and_repeat_nothing(spark, tile_rows):
    left, right = people(spark), people(spark, seed=4, shift=500)
    got = ids(tiled_join(left, right, ["country"], "id", tile_rows))
    expected = [
        (a.id, b.id)
        for a, b in itertools.product(left.collect(), right.collect())
        if a.country is not None and a.country == b.country
    ]
    assert got == sorted(expected)


def test_rules_give_each_pair_once(spark):
    df = people(spark)
    rules = [block_on("country", "name"), block_on("country", "year")]
    got = ids(candidate_pairs(df, None, "id", rules, tile_rows=5))
    expected = [
        (a.id, b.id)
        for a, b in itertools.combinations(sorted(df.collect()), 2)
        if a.country is not None
        and a.country == b.country
        and (a.year == b.year or (a.name is not None and a.name == b.name))
    ]
    assert got == sorted(expected)


def test_range_rule_is_directed(spark):
    df = people(spark, 40)
    rule = Rule(("country",), lambda: F.col("year_l") < F.col("year_r"))
    got = ids(candidate_pairs(df, None, "id", [rule], directed=True))
    expected = [
        (a.id, b.id)
        for a, b in itertools.permutations(df.collect(), 2)
        if a.country is not None and a.country == b.country and a.year < b.year
    ]
    assert got == sorted(expected)


def test_block_sizes_count_pairs(spark):
    df = people(spark)
    sizes = {r.country: r.pairs for r in block_sizes(df, None, ["country"]).collect()}
    pairs = candidate_pairs(df, None, "id", [block_on("country")])
    assert sizes == {r.country_l: r["count"] for r in pairs.groupBy("country_l").count().collect()}


@pytest.mark.parametrize(
    "make",
    [
        lambda: lv.exact("name"),
        lambda: lv.within_km("lat", "lon", 20.0),
        lambda: lv.within_km("lat", "lon", 2.0),
        lambda: lv.within_share("size", 0.05),
        lambda: lv.within_share("size", 0.25),
        lambda: lv.within_difference("year", 2),
        lambda: lv.any_of(lv.exact("year"), lv.within_km("lat", "lon", 5.0)),
        lambda: lv.all_of(lv.similar("name", 0.9), lv.exact("year")),
        lambda: lv.similar("name", 0.9),
    ],
)
def test_index_keys_find_every_pair_of_a_level(spark, make):
    df, level = people(spark), make()
    comparison = lv.compare("x", level, lv.otherwise())
    every = lv.with_gammas(candidate_pairs(df, None, "id", [block_on("country")]), [comparison])
    found = lv.with_gammas(indexed_pairs(df, None, "id", block_on("country"), [level]), [comparison])
    expected = ids(every.where("gamma_x = 1"))
    assert ids(found.where("gamma_x = 1")) == expected
    assert expected


def test_grid_cells_work_at_poles_and_date_line(spark):
    points = [(89.99, 10.0), (89.99, -170.0), (0.0, 179.99), (0.0, -179.99), (-45.0, 0.0), (-45.05, 0.05)]
    df = spark.createDataFrame(
        [(f"p{i}", 1, la, lo) for i, (la, lo) in enumerate(points)],
        "id string, k int, lat double, lon double",
    )
    level = lv.within_km("lat", "lon", 10.0)
    pairs = indexed_pairs(df, None, "id", block_on("k"), [level]).where(level.condition)
    assert ids(pairs) == [("p0", "p1"), ("p2", "p3"), ("p4", "p5")]


def comparisons():
    return (
        lv.name_match("name", tf=True),
        lv.compare(
            "size", lv.null_level("size"), lv.within_share("size", 0.05), lv.within_share("size", 0.25),
            lv.otherwise(),
        ),
        lv.compare(
            "place", lv.null_level("lat", "lon"), lv.within_km("lat", "lon", 5.0),
            lv.within_km("lat", "lon", 25.0), lv.otherwise(),
        ),
        lv.exact_match("year"),
    )


def a_model():
    return Model(
        comparisons(),
        0.01,
        {"name": {3: 0.7, 2: 0.15, 1: 0.1, 0: 0.05}, "size": {2: 0.8, 1: 0.1, 0: 0.1},
         "place": {2: 0.8, 1: 0.15, 0: 0.05}, "year": {1: 0.9, 0: 0.1}},
        {"name": {3: 0.2, 2: 0.1, 1: 0.3, 0: 0.4}, "size": {2: 0.1, 1: 0.1, 0: 0.8},
         "place": {2: 0.01, 1: 0.2, 0: 0.79}, "year": {1: 0.1, 0: 0.9}},
    )


@pytest.mark.parametrize("threshold", [-4.0, 0.0, 2.0, 5.0])
def test_predict_equals_scoring_every_pair(spark, threshold):
    left, right, model = people(spark), people(spark, seed=4, shift=500), a_model()
    from panelforge.linkage.score import add_term_frequencies

    full = candidate_pairs(
        add_term_frequencies(left, model, right),
        add_term_frequencies(right, model, left),
        "id",
        [block_on("country")],
    )
    expected = score(full, model).where(F.col("match_weight") >= threshold)
    got = predict(left, right, "id", [block_on("country")], model, threshold)
    want = {(r.id_l, r.id_r): r.match_weight for r in expected.collect()}
    have = {(r.id_l, r.id_r): r.match_weight for r in got.collect()}
    assert have == pytest.approx(want)


def test_index_is_used_only_when_proven(spark):
    model = a_model()
    assert index_levels(model, 2.0) is not None
    # So low that even disagreement everywhere passes: no list can be complete.
    assert index_levels(model, -100.0) is None


def test_score_is_log_odds(spark):
    row = spark.createDataFrame(
        [("a", "b", "x", "x", 1.0, 1.0, None, None, None, None, 1, 1)],
        "id_l string, id_r string, name_l string, name_r string, size_l double, size_r double, "
        "lat_l double, lat_r double, lon_l double, lon_r double, year_l int, year_r int",
    )
    got = score(row, a_model()).first()
    odds = 0.01 / 0.99 * (0.7 / 0.2) * (0.8 / 0.1) * (0.9 / 0.1)
    assert got.match_weight == pytest.approx(math.log2(odds))
    assert got.match_probability == pytest.approx(odds / (1 + odds))
    assert (got.gamma_name, got.gamma_size, got.gamma_place, got.gamma_year) == (3, 2, -1, 1)


def test_prior_counts_overlapping_rules_once(spark):
    df = people(spark)
    rules = [("country", "name"), ("country", "year"), ("year", "size")]
    got = deterministic_pairs(df, None, rules).first().pairs

    def agree(a, b):
        return any(
            all(getattr(a, k) is not None and getattr(a, k) == getattr(b, k) for k in rule)
            for rule in rules
        )

    expected = sum(agree(a, b) for a, b in itertools.combinations(df.collect(), 2))
    assert got == expected
    assert estimate_prior(df, None, rules, 0.8) == pytest.approx(expected / 0.8 / (120 * 119 / 2))


def test_random_pairs_are_about_as_many_as_asked(spark):
    left = spark.range(3000).selectExpr("id", "id % 7 AS hot")
    assert total_pairs(left, None) == 3000 * 2999 / 2
    n = random_pairs(left, None, "id", max_pairs=20000).count()
    assert 18000 < n < 22000
    everything = random_pairs(people(spark, 30), None, "id", max_pairs=1e6)
    assert everything.count() == 30 * 29 / 2


def test_training_invariants(spark):
    left, right = people(spark), people(spark, seed=4, shift=500)
    model = estimate_u(starting_model(comparisons()), random_pairs(left, right, "id"))
    for c in model.comparisons:
        assert sum(model.u[c.name].values()) == pytest.approx(1.0, abs=1e-6)
    rule = block_on("country", "year")
    run = train_m(model, candidate_pairs(left, right, "id", [rule]), rule)
    assert set(run.m) == {"name", "size", "place"}
    for by_gamma in run.m.values():
        assert sum(by_gamma.values()) == pytest.approx(1.0, abs=1e-6)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(run.log_likelihood))


def test_fixed_levels_stay_fixed(spark):
    fixed = lv.compare(
        "year", lv.null_level("year"), lv.exact("year").with_fixed(0.9999, 0.0001), lv.otherwise()
    )
    left, right = people(spark), people(spark, seed=4, shift=500)
    model = fit(
        (*comparisons()[:3], fixed), left, right, "id", [("country", "name", "year")], 0.7,
        [block_on("country", "name")],
    )
    assert (model.m["year"][1], model.u["year"][1]) == (0.9999, 0.0001)


def texts(spark, n=150, seed=1):
    """Names with small changes: swapped, doubled and dropped letters, other first letters."""
    rng = random.Random(seed)
    stems = ["kraftwerk nord", "heizwerk süd", "central", "a", "ab", "mmmmmm", "zeche zollverein"]
    data = [("none", None), ("empty", ""), ("long", "kraftwerk " * 30)]
    for i in range(n):
        name = list(rng.choice(stems))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(name))
            name[k] = rng.choice(["", name[k] * 2, rng.choice("abkz"), name[-1]])
        data.append((f"t{i:04d}", "".join(name)))
    return spark.createDataFrame([(i, 1, t) for i, t in data], "id string, k int, name string")


@pytest.mark.parametrize("threshold", [0.95, 0.9, 0.8, 0.7, 0.4])
def test_letter_keys_find_every_similar_pair(spark, threshold):
    df = texts(spark)
    rows = [(r.id, r.name.encode()) for r in df.collect() if r.name is not None]
    expected = sorted(
        tuple(sorted((a, b)))
        for (a, x), (b, y) in itertools.combinations(rows, 2)
        if _jaro_winkler(x, y) >= threshold
    )
    for order in (None, letter_order(df, "name")):
        level = lv.similar("name", threshold, order=order)
        comparison = lv.compare("x", level, lv.otherwise())
        pairs = indexed_pairs(df, None, "id", block_on("k"), [level])
        assert ids(lv.with_gammas(pairs, [comparison]).where("gamma_x = 1")) == expected


def text_model():
    return Model(
        (lv.name_match("name", (0.95, 0.9)),), 0.01,
        {"name": {3: 0.7, 2: 0.2, 1: 0.05, 0: 0.05}},
        {"name": {3: 0.001, 2: 0.002, 1: 0.01, 0: 0.987}},
    )


def test_few_pairs_reach_the_text_function(spark):
    df, model = texts(spark), text_model()
    full = candidate_pairs(df, None, "id", [block_on("k")])
    expected = ids(score(full, model).where("match_weight >= 0"))
    lettered, _ = scoring._with_both_letters(df, None, model)
    hopeful = possible(candidate_pairs(lettered, None, "id", [block_on("k")]), model, 0.0)
    assert set(expected) <= set(ids(hopeful)) and expected
    assert hopeful.count() < full.count() / 3
    assert ids(predict(df, None, "id", [block_on("k")], model, 0.0)) == expected


def test_index_or_block_by_number_of_pairs(spark):
    df, model = texts(spark), text_model()
    near = [level for _, _, level in index_levels(model, 0.0)]
    index = KeyIndex(df, None, block_on("k"), near)
    formed = tiled_join(index.left.withColumn("_key", F.explode("_keys")),
                        index.right.withColumn("_key", F.explode("_keys")), index.on, "id")
    assert index.pairs_formed() == formed.count()
    # An index on a value that half of all records have is worse than the blocks themselves.
    two = df.withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)))
    rules = [block_on("k", "half"), block_on("k")]
    for levels in ([lv.exact("half"), lv.exact("k")], near):
        pairs = scoring.planned_pairs(two, None, "id", rules, levels)
        block = candidate_pairs(two, None, "id", rules)
        reach = lv.compare("x", lv.any_of(*levels), lv.otherwise())
        got, want = (lv.with_gammas(p, [reach]).where("gamma_x = 1") for p in (pairs, block))
        keyed = ["id_l", "id_r", "match_key"]
        assert sorted(got.select(keyed).collect()) == sorted(want.select(keyed).collect())


def test_levels_that_most_pairs_reach_are_no_index(spark):
    model = Model(
        (lv.exact_match("kind"), lv.exact_match("year")), 0.01,
        {"kind": {1: 0.99, 0: 0.01}, "year": {1: 0.9, 0: 0.1}},
        {"kind": {1: 0.5, 0: 0.5}, "year": {1: 0.001, 0: 0.999}},
    )
    assert [(name, g) for name, g, _ in index_levels(model, 0.0)] == [("year", 1)]


def test_range_rules_form_few_pairs_in_vain(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 2]), rng.randrange(8), rng.random()) for i in range(400)]
    rows += [(1000 + i, None, 1, 0.5) for i in range(3)] + [(2000 + i, 1, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, k int, year int, size double")
    for column, most in (("year", 1.0), ("size", 1.1)):
        want = sorted(
            (a.id, b.id)
            for a, b in itertools.permutations(df.collect(), 2)
            if None not in (a.k, a[column], b[column]) and a.k == b.k and a[column] < b[column]
        )
        rule = Rule(("k",), before=(column, column))
        pairs = candidate_pairs(df, None, "id", [rule], directed=True)
        assert ids(pairs) == want
        joined = range_join(df, df, ["k"], (column, column), "id", tile_rows=50)
        assert ids(joined) == want
        met = range_join(df, df, ["k"], (column, column), "id", tile_rows=50, check=False)
        assert len(want) <= met.count() <= most * len(want)


def test_clusters_of_hubs_chains_and_lone_records(spark):
    rng = random.Random(5)
    pairs = [(0, k, 5.0) for k in range(1, 300)] + [(k, k + 1, 3.0) for k in range(1000, 1080)]
    pairs += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400), rng.random() * 4) for _ in range(300)]
    pairs += [(None, 3, 9.0), (5, 2999, None), (7, 7, 9.0), (1080, 1000, 3.0)]
    frame = spark.createDataFrame(pairs, "id_l long, id_r long, w double")
    records = spark.range(3000)
    root = {k: k for k in range(3000)}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b, w in pairs:
        if a is not None and w is not None and w >= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {k: find(k) for k in root}
    assert {r.id: r.cluster for r in clusters(frame, "id", "w", 2.0, records, 4).collect()} == want
    linked = {r.id: r.cluster for r in clusters(frame, "id", "w", 2.0).collect()}
    assert linked.items() <= want.items() and {0, 299, 1080} <= set(linked) and 2999 not in linked
    assert clusters(frame.limit(0), "id", "w", 2.0).count() == 0


def test_matching_is_the_greedy_one(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(40), rng.randrange(40), rng.randrange(6) / 2) for _ in range(250)]
    pairs += [(100 + k, 100 + k + d, 50.0 - 2 * k - d) for k in range(20) for d in (0, 1)]
    pairs += [(None, 1, 9.0), (1, None, 9.0), (500, 500, None), pairs[0]]
    frame = spark.createDataFrame(pairs, "l long, r long, w double")
    used_l, used_r, want = set(), set(), []
    whole = {p for p in pairs if None not in p}
    for a, b, w in sorted(whole, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_l and b not in used_r:
            used_l.add(a)
            used_r.add(b)
            want.append((a, b, w))
    got = one_to_one_matching(frame, "l", "r", "w")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert one_to_one_matching(frame.limit(0), "l", "r", "w").count() == 0


def test_training_raises_unless_settled(spark):
    left, right = people(spark), people(spark, seed=4, shift=500)
    rule = block_on("country", "year")
    pairs = candidate_pairs(left, right, "id", [rule])
    with pytest.raises(RuntimeError, match="settled"):
        train_m(starting_model(comparisons()), pairs, rule, iterations=2)


def test_one_wide_bucket_of_random_pairs_is_dealt_in_tiles(spark):
    left = spark.range(5000)
    pairs = random_pairs(left, None, "id", max_pairs=1e9)
    assert "_tile_l" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 5000 * 4999 / 2


def test_combined_levels_form_fewer_pairs_and_lose_none(spark):
    """Dates, prices and kinds in one block: what pairs at the threshold have in common is one key."""
    rng = random.Random(11)
    rows = [
        (i, "b", rng.randint(0, 30), rng.uniform(1, 100), rng.choice("uvwx")) for i in range(600)
    ]
    df = spark.createDataFrame(rows, "id long, k string, day int, price double, kind string")
    comparisons = (
        lv.compare("day", lv.null_level("day"), lv.exact("day"), lv.within_difference("day", 3),
                   lv.otherwise()),
        lv.compare("price", lv.null_level("price"), lv.within_share("price", 0.01),
                   lv.within_share("price", 0.2), lv.otherwise()),
        lv.exact_match("kind"),
    )
    m = {"day": {2: 0.7, 1: 0.2, 0: 0.1}, "price": {2: 0.8, 1: 0.1, 0: 0.1}, "kind": {1: 0.9, 0: 0.1}}
    u = {"day": {2: 0.03, 1: 0.2, 0: 0.77}, "price": {2: 0.01, 1: 0.2, 0: 0.79}, "kind": {1: 0.2, 0: 0.8}}
    model = Model(comparisons, 0.01, m, u)
    single = [level for _, _, level in index_levels(model, 0.0)]
    combined = scoring.index_combinations(model, 0.0, never={"day", "price", "kind"})
    formed = [KeyIndex(df, None, block_on("k"), levels).pairs_formed() for levels in (single, combined)]
    assert formed[1] < 0.5 * formed[0]
    # A missing price is neutral, so the keys may not ask for one where prices are missing.
    lacking = df.withColumn("price", F.when(F.col("id") % 7 != 0, F.col("price")))
    for records in (df, lacking):
        want = score(candidate_pairs(records, None, "id", [block_on("k")]), model)
        assert ids(predict(records, None, "id", [block_on("k")], model, 0.0)) == ids(
            want.where("match_weight >= 0")
        )


def dated_records(spark, n=500, seed=12):
    """Records with dates, prices (some missing, zero or equal) and kinds."""
    rng = random.Random(seed)
    prices = [None, 0.0, 10.0, 10.05, 99.0]
    rows = [
        (i, rng.choice([1, 2, None]), rng.randint(0, 5), rng.choice(prices), rng.choice("uv"))
        if i % 3
        else (i, rng.choice([1, 2]), rng.randint(0, 5), rng.uniform(5, 100), rng.choice("uv"))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, mon int, day int, price double, kind string")


def dated_model():
    comparisons = (
        lv.compare("mon", lv.null_when((F.col("mon_l") == 1) & (F.col("mon_r") == 1), "mon"),
                   lv.exact("mon"), lv.otherwise()),
        lv.compare("day", lv.null_level("day"), lv.exact("day"), lv.within_difference("day", 2),
                   lv.otherwise()),
        lv.compare("price", lv.null_level("price"), lv.within_share("price", 0.01),
                   lv.within_share("price", 0.2), lv.otherwise()),
        lv.exact_match("kind"),
    )
    m = {"mon": {1: 0.9, 0: 0.1}, "day": {2: 0.7, 1: 0.2, 0: 0.1},
         "price": {2: 0.8, 1: 0.1, 0: 0.1}, "kind": {1: 0.9, 0: 0.1}}
    u = {"mon": {1: 0.01, 0: 0.99}, "day": {2: 0.17, 1: 0.4, 0: 0.43},
         "price": {2: 0.01, 1: 0.2, 0: 0.79}, "kind": {1: 0.5, 0: 0.5}}
    return Model(comparisons, 0.002, m, u)


def test_what_a_block_has_equal_is_no_index_and_loses_no_pair(spark):
    df, model = dated_records(spark), dated_model()
    rules = [block_on("kind", "day"), block_on("mon")]
    full = score(candidate_pairs(df, None, "id", rules), model)
    keyed = ["id_l", "id_r", "match_key", "match_weight", "match_probability"]
    want = sorted(full.select(keyed).collect())
    for threshold in (0.0, 2.0):
        listed = scoring.index_combinations(model, threshold, 0.0, {"day"}, equal=("mon",))
        # In a block of equal months a key on the month would be all of the block.
        assert all("mon" not in level.columns for level in listed or ())
        got = sorted(predict(df, None, "id", rules, model, threshold).select(keyed).collect())
        assert got == [r for r in want if r.match_weight >= threshold]
        assert {r.match_key for r in got} == {0, 1}


def test_keys_are_worked_out_once_each(spark):
    """A key of several levels, or tests on it, must not repeat what it is made of."""
    df, model = dated_records(spark), dated_model()
    levels = scoring.index_combinations(model, 4.0, 0.0, {"day", "kind", "price"}, equal=("mon",))
    index = KeyIndex(df, None, block_on("mon"), levels)
    for at in (0, 1):
        plan = index.exploded(at)._jdf.queryExecution().optimizedPlan().toString()
        assert "size(" not in plan and "filter(" not in plan
        assert plan.count("eq:kind:kind") <= 1 and plan.count("eq:day:day") <= 1
    # Each key of a record comes once, and none is missing.
    rows = index.exploded(1).select("id", "_key").collect()
    assert len(rows) == len(set(rows))
    keys = index.right.select("id", F.explode("_keys").alias("_key")).where("_key IS NOT NULL")
    assert sorted(rows) == sorted(keys.collect())


def test_numbers_by_pattern_equal_those_by_pair(spark):
    df, model = dated_records(spark, 120), dated_model()
    pairs = score(candidate_pairs(df, None, "id", [block_on("kind")]), model)
    by_pattern = scoring.per_pattern(model, lambda w: F.round(scoring.probability(w), 9))
    both = pairs.select(
        F.round(scoring.probability(F.col("match_weight")), 9).alias("pair"),
        by_pattern.alias("pattern"),
        F.round("match_weight", 6).alias("w"),
        scoring.per_pattern(model, lambda w: F.round(w, 6), 1.0).alias("high"),
        (F.col("match_probability") == scoring.probability(F.col("match_weight"))).alias("same"),
        "match_weight",
    ).collect()
    assert all(r.pair == r.pattern and r.same for r in both)
    assert all(r.high == (r.w if r.match_weight >= 1.0 else None) for r in both)
    assert {r.high is None for r in both} == {True, False}
    from panelforge.plans.linking import _rounded, _rounded_by_pattern

    quick = _rounded_by_pattern(pairs.where("match_weight >= 1"), model, 1.0)
    assert "round(" not in quick._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(quick.collect()) == sorted(_rounded(pairs.where("match_weight >= 1")).collect())
    # Weights that depend on the value too have no number by pattern.
    assert scoring.per_pattern(a_model(), lambda w: w) is None


def test_best_by_weight_settles_ties_by_partner_and_keeps_rows_whole(spark):
    rows = [
        ("a", 2, 5.0, "x"), ("a", 1, 5.0, "b"), ("a", 3, 5.0, "z"), ("a", 0, 4.0, "y"),
        ("b", 7, 1.0, None), ("b", 6, 0.5, "q"), ("c", None, 9.0, "u"), ("c", 4, None, "v"),
        ("d", 1, 8.0, "m"), ("d", 2, float("nan"), "n"),
    ]
    pairs = spark.createDataFrame(rows, "record string, partner long, weight double, note string")
    best = best_by_weight(pairs, "record", "partner", "weight", ["note"])
    assert sorted(map(tuple, best.collect())) == [
        ("a", 1, "b"), ("b", 7, None), ("c", None, None), ("d", 2, "n"),
    ]


def test_pairs_of_one_small_file_are_formed_by_many_tasks(spark, tmp_path):
    spark.range(3000).selectExpr("id", "id % 100 AS k").coalesce(1).write.parquet(f"{tmp_path}/r")
    df = spark.read.parquet(f"{tmp_path}/r")
    pairs = indexed_pairs(df, df, "id", block_on("k"), [lv.exact("k")])
    tasks = pairs.groupBy(F.spark_partition_id()).count().count()
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) / 2


def sized_texts(spark, n=220, seed=4):
    """Texts in one wide block, some empty, missing or long, with sizes and narrow groups."""
    rng = random.Random(seed)
    rows = texts(spark, n, seed).collect()
    sizes = [None, 0, 100, 101, 103, 140, 141, 400]
    data = [(r.id, 1, i % 70, r.name, rng.choice(sizes)) for i, r in enumerate(rows)]
    data += [("e2", 1, 0, "", 100), ("long2", 1, 3, "kraftwerk " * 29 + "kraftwrek", 141)]
    return spark.createDataFrame(data, "id string, k int, few int, name string, size int")


def sized_text_model():
    """Texts of 0.95 need a size that is close, those of 0.98 do not."""
    return Model(
        (
            lv.name_match("name", (0.98, 0.9)),
            lv.compare("size", lv.null_level("size"), lv.within_share("size", 0.05), lv.otherwise()),
        ), 0.0005,
        {"name": {3: 0.5, 2: 0.3, 1: 0.15, 0: 0.05}, "size": {1: 0.7, 0: 0.3}},
        {"name": {3: 0.0001, 2: 0.0005, 1: 0.02, 0: 0.9794}, "size": {1: 0.05, 0: 0.95}},
    )


def test_searches_find_every_pair_once_and_form_few(spark, monkeypatch):
    df, model = sized_texts(spark), sized_text_model()
    wide, narrow = scoring.text_searches(model, -5.0)
    assert (wide.least, wide.below, wide.within) == (0.98, None, None)
    assert (narrow.least, narrow.below) == (0.9, 0.98) and narrow.within is not None
    full = candidate_pairs(df, None, "id", [block_on("k")])
    expected = {
        (r.id_l, r.id_r): r.match_weight
        for r in score(full, model).where("match_weight >= -5").collect()
    }
    assert ("e2", "empty") in expected and ("long", "long2") in expected
    for group_pairs in (0, scoring.GROUP_PAIRS):  # with and without the narrow search
        monkeypatch.setattr(scoring, "GROUP_PAIRS", group_pairs)
        found = scoring.searched_pairs(df, None, "id", block_on("k"), [wide, narrow])
        assert len(ids(found)) == len(set(ids(found))) < full.count() / 3
        assert set(expected) <= set(ids(found))
        got = predict(df, None, "id", [block_on("k")], model, -5.0)
        # No pair of a block is formed to count its letters.
        assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
        have = {(r.id_l, r.id_r): r.match_weight for r in got.collect()}
        assert have == pytest.approx(expected)


def test_searches_stand_beside_blocks_of_other_rules(spark):
    df, model = sized_texts(spark), sized_text_model()
    rules = [block_on("few"), block_on("k")]
    want = score(candidate_pairs(df, None, "id", rules), model).where("match_weight >= -5")
    got = predict(df, None, "id", rules, model, -5.0)
    keyed = ["id_l", "id_r", "match_key"]
    assert sorted(got.select(keyed).collect()) == sorted(want.select(keyed).collect())
    assert got.where("match_key = 0").count() and got.where("match_key = 1").count()


@pytest.mark.parametrize("threshold", [0.95, 0.3])
def test_tiles_of_texts_lose_no_similar_pair(spark, monkeypatch, threshold):
    monkeypatch.setattr(text_search, "_LETTERS", 40)
    monkeypatch.setattr(text_search, "_ROWS", 7)
    left, right = sized_texts(spark, 90), sized_texts(spark, 60, 9)
    search = text_search.TextSearch(lv.Similarity("name", "name"), threshold)
    rows = [[(r.id, r.name.encode()) for r in d.collect() if r.name is not None] for d in (left, right)]
    for others, once in ((1, False), (0, True)):
        expected = {
            (a, b)
            for (a, x), (b, y) in itertools.product(rows[0], rows[others])
            if (not once or a < b) and (_jaro_winkler(x, y) >= threshold or x == y)
        }
        pairs = text_search.text_join(left, [left, right][others], ["k"], "id", search, once, 25)
        found = ids(pairs)
        assert len(found) == len(set(found)) and expected <= set(found)
        assert not once or all(a < b for a, b in found)
