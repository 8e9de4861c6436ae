import hashlib
import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from panelforge.llm import vector_codes
from tests.llm import edge

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """(rows of (vec_id, code, error, label error), digest) by measuring every distance."""
    fit = [r for r in rows if r[1] and len(r[1]) % parts == 0
           and all(x is not None and math.isfinite(x) for x in r[1])]
    if not fit:
        return [], None
    size = len(min(fit, key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))[1])
    fit = [(i, [math.floor(4096 * Fraction(x)) for x in v], g) for i, v, g in fit if len(v) == size]
    least = {}
    for i, v, _ in fit:
        if i is not None:
            least[i] = min(v, least.get(i, v))
    starts = [least[i] for i in sorted(least)[:entries]]
    w = size // parts
    books = [[v[p * w : (p + 1) * w] for v in starts] for p in range(parts)]

    def nearest(v, p):
        own = v[p * w : (p + 1) * w]
        return min(
            (sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), k)
            for k, e in enumerate(books[p])
        )

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in fit:
                got.setdefault(nearest(v, p)[1], []).append(v[p * w : (p + 1) * w])
            books[p] = [
                [sum(c) // len(got[k]) for c in zip(*got[k], strict=True)] if k in got else e
                for k, e in enumerate(books[p])
            ]
    out, by_label = [], {}
    for i, v, g in fit:
        near = [nearest(v, p) for p in range(parts)]
        error = sum(d for d, _ in near)
        out.append((i, g, "".join(f"{k:02x}" for _, k in near), error))
        by_label[g] = by_label.get(g, 0) + error
    most = (1 << 63) - 1
    rows = [(i, c, min(e, most), min(by_label[g], most)) for i, g, c, e in out]
    numbers = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(rows, key=edge.key), hashlib.sha256(numbers.encode()).hexdigest()


def mine(frame, **options):
    coded, books = vector_codes.compress(frame, **options)
    rows = vector_codes.with_group_error(coded).select("vec_id", "code", "error", "label_error")
    return sorted(map(tuple, rows.collect()), key=edge.key), books.digest()


def vectors(seed, n, size, coarse):
    rng = random.Random(seed)
    return [
        (k, [rng.randrange(-3, 4) / 4096 if coarse else rng.gauss(0, 1) for _ in range(size)],
         rng.choice([None, 1, 2]))
        for k in rng.sample(range(-n, 3 * n), n)
    ]


def test_matches_brute_force(spark):
    for seed, n, size, coarse in ((1, 300, 16, False), (2, 300, 16, True), (3, 5, 24, False)):
        rows = vectors(seed, n, size, coarse)
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert mine(frame) == brute(rows)


def test_edge_cases(spark):
    rng = random.Random(9)
    rows = vectors(4, 40, 16, False)
    rows += rows[:3] + [(rows[0][0], rows[5][1], 1)]
    rows += [(None, rows[7][1], None), (900, None, 1), (901, [], 1), (902, [0.5] * 8, 1)]
    rows += [(903, [None] + [0.5] * 15, 1), (904, [float("nan")] * 16, 1), (905, [0.5] * 15, 2)]
    rows += [(906, [float("-inf")] * 16, 1), (907, [-0.0] * 16, 1)]
    rows += [(908, [rng.gauss(0, 1e18) for _ in range(16)], 2), (909, [1e308] * 16, 2)]
    frame = edge.clash(spark.createDataFrame(rows, SCHEMA), "code", "error", "vector", "part")
    assert mine(frame) == brute(rows)
    assert mine(spark.createDataFrame([], SCHEMA))[0] == []
    coded, _ = vector_codes.compress(spark.createDataFrame([(None, [1.0] * 8, 3)], SCHEMA))
    assert [tuple(r) for r in coded.collect()] == [(None, 3, None, None)]


def test_search_skips_what_cannot_be_nearer():
    rng = np.random.default_rng(5)
    centres = rng.integers(-100_000, 100_000, size=(64, 4))
    book = vector_codes.Codebook(centres)
    values = centres[rng.integers(0, 64, 2000)] + rng.integers(-500, 500, size=(2000, 4))
    asked = []
    between = vector_codes.Codebook._between
    book._between = lambda a, b: asked.append(len(a)) or between(a, b)
    best, error = book.nearest(values)
    every = ((values[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()
    assert sum(asked) < 2000 * 64 / 4


def test_restored_vectors_are_near(spark):
    rows = vectors(6, 200, 16, False)
    frame = spark.createDataFrame(rows, SCHEMA)
    coded, books = vector_codes.compress(frame)
    back = coded.select("vec_id", "error", vector_codes.restored(F.col("code"), books).alias("v"))
    given = {i: v for i, v, _ in rows}
    for r in back.collect():
        apart = sum((a - b) ** 2 for a, b in zip(given[r.vec_id], r.v, strict=True))
        assert abs(apart - r.error / 4096**2) < 0.01
