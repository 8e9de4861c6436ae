import random

import numpy as np
import xxhash

from panelforge.llm import simhash
from panelforge.llm.components import components
from tests.llm import edge


def reference(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < 4:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashed = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def groups(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    return {p: find(p) for p in prints}


def test_fingerprints_and_edge_cases(spark):
    found = simhash.near_groups(edge.clash(edge.docs(spark), "fp", "component_id"))
    texts = {(r.doc_id, simhash.fingerprint_of(r.text)) for r in edge.docs(spark).collect()}
    rows = found.collect()
    assert len(rows) == 12 and {(r.doc_id, r.fp) for r in rows} == texts
    for r in edge.docs(spark).collect():
        assert simhash.fingerprint_of(r.text) & (1 << 64) - 1 == reference(r.text)
    by_id = {r.doc_id: r.component_id for r in rows}
    assert by_id[3] == 1 and by_id[5] == by_id[6] == by_id[4] == 4
    assert simhash.near_groups(edge.docs(spark, [])).count() == 0


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(rng.randrange(8)):
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                p ^= 1 << bit
            prints.add(p)
    signed = {p: int(np.array([p], dtype=np.uint64).view(np.int64)[0]) for p in prints}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    for buffer in (1 << 22, 1 << 11):  # the small buffer splits the space further in the task
        links = simhash.near_links(frame, "fp", buffer=buffer)
        root = {r.node: r.root for r in components(links, "a", "b").collect()}
        want = groups(prints)
        mine = {p: root.get(signed[p], signed[p]) for p in prints}
        pairs = {(want[p], mine[p]) for p in prints}
        assert len(pairs) == len(set(want.values())) == len(set(mine.values()))


def test_one_document_of_each_group_stays(spark):
    kept = simhash.keep_one_per_group(edge.docs(spark)).collect()
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept)
    assert (True, 1) in ids and (True, 3) not in ids and (False, 0) in ids


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    found = components(links, "a", "b").collect()
    assert len(found) == 201 and {r.root for r in found} == {0}
