import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelforge.llm import kneser_ney
from tests.llm import edge

ORDER = 3


def brute(texts, order=ORDER):
    """Perplexity function of a model over texts, by definition."""

    def prepared(text):
        return b"\0" * (order - 1) + b" ".join((text or "").encode().split())

    counts = {order: Counter()}
    for text in texts:
        data = prepared(text)
        counts[order].update(data[k - order + 1 : k + 1] for k in range(order - 1, len(data)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, context = {}, {}
    for k, table in counts.items():
        n = Counter(table.values())
        discount[k] = (0.5, 0.75, 0.9)
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            found = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2]]
            found.append(3 - 4 * y * n[4] / n[3] if n[3] else 3 * y)
            discount[k] = tuple(min(max(d, 0.1), i) for i, d in enumerate(found, 1))
        context[k] = {}
        for gram, c in table.items():
            entry = context[k].setdefault(gram[:-1], [0, 0.0])
            entry[0] += c
            entry[1] += discount[k][min(c, 3) - 1]

    def probability(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        entry, below = context[k].get(gram[:-1]), probability(gram[1:])
        if entry is None:
            return below
        c = counts[k].get(gram, 0)
        own = c - discount[k][min(c, 3) - 1] if c else 0
        return own / entry[0] + entry[1] / entry[0] * below

    def perplexity(text):
        data = prepared(text)
        size = len(data) - order + 1
        if not size:
            return None
        logs = (math.log(probability(data[k - order + 1 : k + 1])) for k in range(order - 1, len(data)))
        return math.exp(-sum(logs) / size)

    return perplexity


def test_probabilities_match_the_definition(spark):
    docs = edge.docs(spark)
    block = F.spark_partition_id().cast("long")
    blocked = kneser_ney.stage(docs.withColumn("__block", block), "blocked")
    good = blocked.where("doc_id IN (1, 2, 3)")
    want = brute([r.text for r in good.collect()])
    trusted = kneser_ney._by_block(good.selectExpr("__block AS block", "doc_id AS id"), "trusted")
    model = kneser_ney.Model(blocked.select("__block", "doc_id", "text"), trusted, ORDER)
    for r in kneser_ney.perplexities(blocked, model).collect():
        expected = want(r.text)
        assert r.perplexity == (None if expected is None else pytest.approx(expected, rel=1e-9))


def test_edge_cases(spark):
    docs = edge.clash(edge.docs(spark), "perplexity", "kept")
    nobody = spark.createDataFrame([], "doc_id long")
    rows = kneser_ney.judge(docs, nobody, order=ORDER).collect()
    assert len(rows) == 12 and all(r.threshold is None for r in rows)
    for r in rows:
        blank = r.doc_id in (4, 5, 6)
        assert r.kept == (not blank)
        assert r.perplexity == (None if blank else pytest.approx(256))
    assert kneser_ney.judge(edge.docs(spark, []), nobody, order=ORDER).count() == 0


def test_good_documents_are_kept(spark):
    table = "/root/testdata/sf0.01/{}.parquet".format
    docs = spark.read.parquet(table("documents"))
    labels = spark.read.parquet(table("labels"))
    trusted = labels.where("quality = 1 AND toxic = 0")
    found = kneser_ney.judge(docs, trusted).select("doc_id", "kept").join(labels, "doc_id")
    rows = found.where("quality = 0 OR toxic = 0").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()
    share = {r.quality: r.s for r in rows}
    assert share[1] > 0.97 and share[0] < 0.4


def _noisy_rows(spark, lang, first, count, rng):
    """Rows of good sentences; one of those held out is noise. Then a row of other noise."""
    words = edge.ENGLISH.split()
    ids = range(first, first + count)
    fold = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(kneser_ney.FOLDS))
    held = [r.id for r in spark.range(first, first + count).where(fold == 0).collect()]
    assert len(held) > 2

    def noise():
        return "".join(rng.choice("qxzjkvw0123456789%&$") for _ in range(400))

    good = [(k, " ".join(rng.sample(words, len(words))), lang, "a") for k in ids if k != held[0]]
    return [*good, (held[0], noise(), lang, "a")], (first + count, noise(), lang, "b")


def test_one_noisy_trusted_document_does_not_set_the_limit(spark):
    rng = random.Random(5)
    many, bad = _noisy_rows(spark, "en", 0, 200, rng)
    few, worse = _noisy_rows(spark, "de", 1000, 25, rng)
    docs = edge.docs(spark, [*many, bad, *few, worse])
    trusted = spark.createDataFrame([(r[0],) for r in [*many, *few]], "doc_id long")
    found = {r.doc_id: r for r in kneser_ney.judge(docs, trusted, order=ORDER).collect()}
    assert not found[bad[0]].kept and not found[worse[0]].kept
    assert sum(found[r[0]].kept for r in many) >= 0.95 * len(many)
    assert sum(found[r[0]].kept for r in few) >= 0.9 * len(few)


def test_few_bad_documents_are_kept(spark):
    table = "/root/testdata/sf0.1/{}.parquet".format
    labels = spark.read.parquet(table("labels"))
    docs = spark.read.parquet(table("documents")).join(labels.select("doc_id"), "doc_id", "left_semi")
    trusted = labels.where("quality = 1 AND toxic = 0")
    found = kneser_ney.judge(docs, trusted).select("doc_id", "kept").join(labels, "doc_id")
    rows = found.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()
    share = {(r.quality, r.toxic): r.s for r in rows}
    assert share[1, 0] > 0.97 and share[0, 0] < 0.05 and share[0, 1] < 0.05


def plain_thresholds(rows, quantile, prior):
    """rows: (lang, perplexity)"""

    def at(values, share):
        return sorted(values)[max(math.ceil(share * len(values)), 1) - 1]

    logs = {}
    for lang, value in rows:
        logs.setdefault(lang, []).append(math.log(value))
    named = {k: v for k, v in logs.items() if k is not None}
    above = {k: at(v, quantile) - at(v, 0.5) for k, v in named.items()}
    shared = sum(len(v) * above[k] for k, v in named.items()) / sum(map(len, named.values()))
    found = {
        k: math.exp(at(v, 0.5) + (len(v) * above[k] + prior * shared) / (len(v) + prior))
        for k, v in named.items()
    }
    return found, math.exp(at([x for v in logs.values() for x in v], quantile))


def test_thresholds_are_language_quantiles(spark):
    rng = random.Random(7)
    rows = [(lang, 3 + 4 * rng.random()) for lang, n in (("en", 500), ("de", 40), ("fr", 1), (None, 9)) for _ in range(n)]
    reference = spark.createDataFrame(rows, "lang string, perplexity double")
    limits, common = kneser_ney.thresholds(reference)
    want, of_all = plain_thresholds(rows, kneser_ney.QUANTILE, kneser_ney.PRIOR)
    assert {r.lang: pytest.approx(r.threshold) for r in limits.collect()} == want
    assert common == pytest.approx(of_all)
    # without a prior it is the quantile itself: the share above it is no more than is left
    own = [p for lang, p in rows if lang == "en"]
    assert sum(p > want["en"] for p in own) <= 0.04 * len(own)
    limits, common = kneser_ney.thresholds(reference.limit(0))
    assert limits.count() == 0 and common is None


def test_languages_without_held_out_text_have_the_common_threshold(spark):
    rng = random.Random(8)
    many, bad = _noisy_rows(spark, "en", 0, 200, rng)
    strange = [(5000, bad[1], None, "a"), (5001, bad[1], "xx", "a"), (5002, many[0][1], None, "a")]
    docs = edge.docs(spark, [*many, *strange])
    trusted = spark.createDataFrame([(r[0],) for r in many], "doc_id long")
    found = {r.doc_id: r for r in kneser_ney.judge(docs, trusted, order=ORDER).collect()}
    assert not found[5000].kept and not found[5001].kept
    assert found[5000].threshold == found[5001].threshold is not None
