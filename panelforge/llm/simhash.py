"""Near-duplicate groups by SimHash and meet-in-the-middle ball hashing.

Two fingerprints differ in at most `radius` bits exactly if some value lies within radius / 2
of both. So every distinct fingerprint emits all values within half the radius, equal values
meet, and what meets is linked. The values of one fingerprint share most leading bits: the
shuffle goes by those bits (a fingerprint is sent once to each prefix that one of its values
has), and the remaining bits are flipped inside the receiving task, which halves its space
again until the values fit a fixed buffer. All who share a value are within the radius of each
other, so a chain through them keeps every link without listing the pairs.

Exact copies collapse into one fingerprint before. Components are resolved on tables in the
shared folder. Null and blank texts have fingerprint zero and link like any other. Repeated
rows each get a result row. A component of rows without ids has a null id.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.components import components
from panelforge.llm.workers import release
from panelforge.sources.staging import stage

SHINGLE = 4
SEED = 42
BITS = 64
RADIUS = 4
#: Values behind one prefix, and values that a task holds at once.
BUFFER = 1 << 22
HELD = 1 << 20
#: Leading bits that the shuffle uses at least; more as fingerprints grow in number.
LEAST_PREFIX = 8
_PIECE = 1 << 15


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text as a signed 64-bit integer."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < shingle:
        grams = [b" ".join(found)]
    else:
        grams = map(b" ".join, zip(*(found[k:] for k in range(shingle)), strict=False))
    hashed = np.fromiter(
        map(partial(xxhash.xxh64_intdigest, seed=seed), grams), dtype="<u8"
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashed), _PIECE):
        piece = hashed[at : at + _PIECE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashed)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint column, a long."""

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle, seed) for t in texts], dtype="int64")

    return made(text)


def _masks(positions: list[int], most: int) -> np.ndarray:
    """All xor masks that flip at most `most` of the positions."""
    found = [0]
    for n in range(1, most + 1):
        found += [sum(1 << p for p in c) for c in combinations(positions, n)]
    return np.array(found, dtype=np.uint64)


def _find_roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index reachable, for edges between indexes below size."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _meetings(prints, index, budget, free: list[int], fixed: np.uint64, buffer: int, out: list):
    """Append chains of indexes of fingerprints that share a value.

    budget: flips each fingerprint may still spend on the free bits; fixed: the other bits.
    """
    if len(prints) < 2:
        return
    masks = {b: _masks(free, int(b)) for b in np.unique(budget)} if len(free) <= BITS else {}
    total = sum(int((budget == b).sum()) * len(m) for b, m in masks.items())
    if total > buffer and free:
        bit, rest = np.uint64(1 << free[0]), free[1:]
        for value in (np.uint64(0), bit):
            left = budget - ((prints & bit) != value)
            stay = left >= 0
            _meetings(
                prints[stay], index[stay], left[stay], rest, fixed | bit, buffer, out
            )
        return
    values, owners = [], []
    for b, masks_b in masks.items():
        own = budget == b
        values.append(((prints[own] & ~fixed)[:, None] ^ masks_b[None, :]).ravel())
        owners.append(np.repeat(index[own], len(masks_b)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    if len(same):
        pairs = np.unique(np.stack([owner[same], owner[same + 1]]), axis=1)
        out.append(pairs)


def _bucket_links(bucket: int, prints: np.ndarray, prefix: list[int], half: int, buffer: int):
    """(fingerprint, least linked fingerprint) among those sent to one prefix."""
    prints = np.unique(prints).view(np.uint64)
    mask = np.uint64(0)
    spent = np.zeros(len(prints), dtype=np.int64)
    for k, p in enumerate(prefix):
        bit = np.uint64(1 << p)
        mask |= bit
        spent += ((prints & bit) != 0) != bool(bucket >> k & 1)
    free = [p for p in range(BITS) if p not in set(prefix)]
    chains: list[np.ndarray] = []
    _meetings(prints, np.arange(len(prints)), half - spent, free, mask, buffer, chains)
    if not chains:
        return prints[:0].view(np.int64), prints[:0].view(np.int64)
    left, right = np.concatenate(chains, axis=1)
    near = np.bitwise_count(prints[left] ^ prints[right]) <= 2 * half
    roots = _find_roots(len(prints), left[near], right[near])
    moved = np.flatnonzero(roots != np.arange(len(prints)))
    signed = prints.view(np.int64)
    return signed[moved], signed[roots[moved]]


def _prefix_bits(prints: DataFrame, column: str, size: int) -> list[int]:
    """The most evenly set bits."""
    one = [
        F.avg(F.shiftrightunsigned(column, p).bitwiseAND(1)).alias(f"b{p}") for p in range(BITS)
    ]
    shares = prints.agg(*one).first()
    return sorted(range(BITS), key=lambda p: (abs((shares[p] or 0.0) - 0.5), p))[:size]


def near_links(
    prints: DataFrame, column: str = "fp", radius: int = RADIUS, buffer: int = BUFFER
) -> DataFrame:
    """(a, b) links that join all fingerprints within the radius; prints holds distinct ones."""
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    rows = prints.count()
    size = LEAST_PREFIX
    balls = len(_masks(list(range(BITS)), half))
    while rows * balls > buffer << size and size < 30:
        size += 1
    prefix = _prefix_bits(prints, column, size)
    home = sum(
        F.shiftrightunsigned(column, p).bitwiseAND(1) * (1 << k) for k, p in enumerate(prefix)
    )
    flips = F.array(*[F.lit(int(m)) for m in _masks(list(range(size)), half)])
    sent = prints.select(
        F.col(column).alias("fp"), F.explode(flips).alias("flip"), home.alias("home")
    ).select("fp", F.col("home").bitwiseXOR(F.col("flip")).alias("bucket"))

    def link(key, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _bucket_links(
            int(key[0]), rows["fp"].to_numpy(), prefix, half, min(buffer, HELD)
        )
        release()
        return pd.DataFrame({"a": a, "b": b})

    return sent.groupBy("bucket").applyInPandas(link, "a long, b long")


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs."""
    marked = stage(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")),
        "fingerprints",
    )
    prints = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(near_links(prints, "fp", radius), "a", "b")
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage(rooted.join(least, "root").select("fp", "component_id"), "groups")
    return marked.join(named, "fp")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """docs without the rows whose group holds a smaller id.

    Rows without an id stay. Rows that share an id are one document: they stay or go together.
    """
    extra = near_groups(docs, doc_id, text, radius=radius).where("doc_id > component_id")
    gone = extra.select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti")
