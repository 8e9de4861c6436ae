import hashlib
import random
import zlib

import pytest

from panelforge.llm import prefix_trie
from tests.llm import edge

SCHEMA = "conv_id long, turn long, role string, text string"


def reference_order(role, text):
    sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return tuple(int.from_bytes(sha[k : k + 8], "big", signed=True) for k in (0, 8))


def brute(rows):
    """Every node of the trie, with rebuilt turn lists."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn or 0, *reference_order(role, text))
            turns.setdefault(c, []).append((order, (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    head = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    paths = {c: tuple(own.get(c - c % 100, [])[: head[c]] + ts[head[c] :]) for c, ts in own.items()}
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == path)
        out.append(
            (
                min(convs),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(convs),
                sum(len(p) == len(path) + 1 for p in under),
                sum(p not in inner for p in under),
                sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=edge.key)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=edge.key)


def talks(seed, n, most, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(4 * n), n):
        for k in range(rng.randrange(1, most)):
            rows.append((c, k, rng.choice("ab"), "w" * rng.randrange(words)))
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed, n, most in ((1, 120, 9), (2, 60, 4)):
        rows = talks(seed, n, most)
        rows += [(1000 * n, k, "a", "w" * (k % 2)) for k in range(60)]  # cut into several pieces
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert found(prefix_trie.trie(frame, chunk=7, packed=4)) == brute(rows)


def test_edge_cases(spark):
    rows = [
        (0, None, "a", "null turn"), (0, 5, None, None), (0, 5, "", "x"), (0, -3, "a", "first"),
        (7, 0, "ab", "c"), (7, 1, "a", "bc"), (8, 0, "a", "bc"), (8, 1, "ab", "c"),
        (9, 0, "a", "same"), (9, 0, "a", "same"), (9, 0, "a", "same"),
        (None, 0, "a", "lost"), (250, 0, "a", "no base"), (251, 0, "u", "é\U0001f600" * 3),
        (-5, 0, "a", "minus"), (-100, 0, "a", "its base"), (300, 1, "a", "long " * 20_000),
        (301, 1, "a", "long " * 20_000), (302, 9, "a", "long " * 20_000),
    ]
    frame = edge.clash(spark.createDataFrame(rows, SCHEMA), "depth", "fp", "content", "n_convs")
    assert found(prefix_trie.trie(frame)) == brute(rows)
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [(None, 1, "a", "x")]
    assert prefix_trie.trie(spark.createDataFrame(only, SCHEMA)).count() == 0


def test_clashing_fingerprints_are_found(spark):
    rows = talks(3, 40, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    for prime in (10_007, 1_000_003):  # small primes clash and are tried again
        assert found(prefix_trie.trie(frame, prime=prime, attempts=40)) == brute(rows)
    with pytest.raises(RuntimeError, match="clash"):
        prefix_trie.trie(frame, prime=7, attempts=2)


def test_a_common_turn_and_many_equal_conversations(spark):
    rows = [(100 * c, k, "a", "hello") for c in range(400) for k in range(1 + (c == 7))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(prefix_trie.trie(frame, packed=16)) == brute(rows)
