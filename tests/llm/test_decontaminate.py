import random
import re

import numpy as np

from panelforge.llm import decontaminate
from tests.llm import edge

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = split(text)
        for k in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[k : k + 10]), set()).add("" if item is None else str(item))
    found = {}
    for doc, text in docs:
        words, hit, names = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                owners = windows.get(tuple(words[k : k + size]))
                if owners:
                    names |= owners
                    hit.update(range(k, k + size))
        found[doc] = (len(words), len(hit), sorted(names))
    return found


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "x1"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 3, 12, 15))))) for k in range(8)]
    for k in range(0, 60, 3):
        item = items[rng.randrange(8)][1].upper()
        docs[k] = (k, f"{docs[k][1]}, {item}. {docs[k][1]}")
    return docs, [*items, (2, "again " * 3), (None, "w1 w2 w3 w4"), (11, None), (12, "!!")]


def test_matches_brute_force_in_blocks_and_shards(spark):
    docs, items = make(1)
    frame = spark.createDataFrame([(k, t, "", "", 0) for k, t in docs], edge.DOCS)
    bench = spark.createDataFrame(items, edge.ITEMS)
    want = brute(docs, items)
    for blocks, shards in ((10_000, 1 << 20), (20, 100), (20, 1 << 20)):
        found = decontaminate.scan(frame, bench, block_words=blocks, shard_words=shards)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
        assert got == want


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 400)
    index = decontaminate.FmIndex(text.astype(np.int64), sample=5)
    words = np.array([[1, 2, 0], [3, 0, 0], [2, 2, 2], [9, 0, 0]])
    lengths = np.array([2, 1, 3, 1])
    for k, low, high in zip(*index.search(words, lengths), strict=True):
        pattern = words[k, : lengths[k]]
        want = [i for i in range(400) if np.array_equal(text[i : i + len(pattern)], pattern)]
        assert sorted(index.locate(np.arange(low, high))) == want


def test_spans_are_removed(spark):
    docs, items = make(2)
    frame = spark.createDataFrame([(k, t, "", "", 0) for k, t in docs], edge.DOCS)
    frame, bench = frame.withColumn("before", frame.text), spark.createDataFrame(items, edge.ITEMS)
    for blocks in (10_000, 20):
        for r in decontaminate.scan(frame, bench, block_words=blocks, cut=True).collect():
            hit = {k for s in r.spans for k in range(s.start, s.end)}
            assert split(r.text) == [w for k, w in enumerate(split(r.before)) if k not in hit]


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, edge.ENGLISH)], edge.ITEMS)
    docs = edge.clash(edge.docs(spark), "items", "n_hit")
    rows = decontaminate.scan(docs, bench).collect()
    assert len(rows) == 12
    assert all((r.n_hit > 0) == bool(r.text and "old mill" in r.text) for r in rows)
    none = decontaminate.scan(edge.docs(spark), bench.limit(0)).collect()
    assert all(r.n_hit == 0 and r["items"] == [] for r in none)
    assert decontaminate.scan(edge.docs(spark, []), bench).count() == 0
