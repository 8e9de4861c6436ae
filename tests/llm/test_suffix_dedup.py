import random

import numpy as np

from panelforge.llm import induced_sorting, suffix_dedup
from tests.llm import edge


def brute(rows):
    """{(doc_id, text): (kept, removed, spans)} by comparing all windows."""
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - 49):
            w = data[k : k + 50]
            key = (doc is None, doc or 0)
            least[w] = min(least.get(w, key), key)
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - 49):
            if least[data[k : k + 50]] < (doc is None, doc or 0):
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        out[doc, text] = (kept, int(gone.sum()), spans)
    return out


def compare(frame):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    want = brute(rows)
    found = suffix_dedup.deduplicate(frame.withColumn("copy", frame.text)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (bytes(r.kept), r.n_removed, r.n_spans) == want[r.doc_id, r.copy]
        assert r.n_bytes == len((r.copy or "").encode())


def test_matches_brute_force(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "dé", "ü", "x" * 70, "ab" * 40, "\x00"]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(4)]
    rows = []
    for k in range(80):
        parts = rng.choices(words, k=rng.randrange(40))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.randrange(20, 140)])
        rows.append((rng.randrange(60), " ".join(parts), None, None))
    compare(edge.docs(spark, rows))


def test_edge_cases(spark):
    compare(edge.docs(spark))
    fifty = "".join(chr(65 + k % 26) + str(k) for k in range(30))[:50]
    rows = [(1, fifty), (2, fifty), (3, fifty[:-1]), (4, "z" + fifty), (5, "a" * 300), (6, "a" * 99)]
    compare(edge.docs(spark, [(*r, None, None) for r in rows]))
    clashing = edge.clash(edge.docs(spark), "kept", "n_bytes")
    found = suffix_dedup.deduplicate(clashing)
    assert len(found.columns) == len(set(found.columns)) and found.count() == 12
    assert suffix_dedup.deduplicate(edge.docs(spark, [])).count() == 0


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1 << 10)
    text = edge.LONG.encode()
    pieces = suffix_dedup._deal([b"short", text[:5000], b"", text[2000:9000]])
    whole = {0: b"short", 1: text[:5000], 3: text[2000:9000]}
    covered = {k: set() for k in whole}
    for k, start, windows, _ in zip(*pieces, strict=True):
        covered[k].update(range(start, start + windows))
    assert all(covered[k] == set(range(max(0, len(t) - 49))) for k, t in whole.items())


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(120):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(1, 50)).astype(np.uint16)
        if trial % 3 == 0:
            s = np.tile(s, 3)
        order = induced_sorting.suffix_array(s, 260)
        assert list(order) == sorted(range(len(s)), key=lambda i: tuple(s[i:]))
        shared = induced_sorting.permuted_prefixes(s, order, 6)
        for a, b in zip(order[:-1], order[1:], strict=True):
            n = 0
            while n < 6 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert shared[b] == n
