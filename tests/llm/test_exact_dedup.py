import hashlib
import random

import pytest

from panelforge.llm import exact_dedup
from tests.llm import edge


def brute(rows):
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    out = []
    for t, ids in by_text.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        stays = True
        for i in ids:
            kept = i == keep and stays
            stays = stays and not kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=edge.key)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=edge.key)


@pytest.mark.parametrize("key_bytes", [32, 1, 0])  # short keys put different texts together
def test_random_rows_in_small_buffers(spark, key_bytes):
    rng = random.Random(key_bytes)
    texts = [None, "", " ", "a", "A", "é", "é", *(f"text {k} " * (k % 7) for k in range(60))]
    rows = [(k if rng.random() < 0.95 else None, rng.choice(texts)) for k in range(900)]
    rows += [(k, "hot") for k in range(1000, 1600)] + [(3, "hot"), (1599, "hot")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    for buffer_bytes in (1, 2000, 1 << 20):
        mine = exact_dedup.groups(
            docs, salts=5, buffer_bytes=buffer_bytes, key_bytes=key_bytes
        )
        assert found(mine) == brute(rows)


def test_edge_cases(spark):
    docs = edge.docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    names = ("row", "rep", "key", "kept", "keep_id", "text_sha256")
    assert found(exact_dedup.groups(edge.clash(docs, *names))) == brute(rows)
    assert exact_dedup.groups(edge.docs(spark, [])).count() == 0
    nulls = [(None, None, None, None), (None, "", None, None), (None, "x", None, None)]
    assert found(exact_dedup.groups(edge.docs(spark, nulls))) == brute([(n, t) for n, t, *_ in nulls])


def test_normalised_texts_and_other_ids(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(
        [("a", "One"), ("b", "one"), ("c", "two"), (None, "ONE")], "name string, body string"
    )
    mine = exact_dedup.groups(docs, "name", "body", lambda t: F.lower(exact_dedup.as_is(t)))
    assert [(r.doc_id, r.keep_id, r.kept) for r in sorted(mine.collect(), key=edge.key)] == [
        (None, "b", False), ("a", "b", False), ("b", "b", True), ("c", "c", True)
    ]


def test_rows_that_stay_keep_their_columns(spark):
    docs = edge.clash(edge.docs(spark), "kept", "row")
    stay = exact_dedup.keep_one(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert stay.columns == docs.columns
    assert sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest())
                   for r in stay.collect()), key=edge.key) == sorted(
        ((i, sha) for i, _, _, kept, sha in brute(rows) if kept), key=edge.key
    )


def test_no_exchange_of_rows_by_text(spark):
    """A hot text's rows follow their names: the result's exchanges go by `rep` only."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "'same' AS text").repartition(8)
    rows = exact_dedup.groups(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Join")[0]
    assert {(r.keep_id, r.group_size) for r in rows.collect()} == {(1999, 2000)}
