"""Similarity of strings and vectors."""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The helpers travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _jaro_winkler(left: bytes, right: bytes) -> float:
    """Jaro similarity, raised by up to four shared leading bytes once above 0.7."""
    n, m = len(left), len(right)
    if not n or not m:
        return 0.0
    if left == right:
        return 1.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken = bytearray(m)
    matched = bytearray()
    for i, byte in enumerate(left):
        start, stop = max(0, i - reach), min(i + reach + 1, m)
        j = right.find(byte, start, stop)
        while j >= 0 and taken[j]:
            j = right.find(byte, j + 1, stop)
        if j >= 0:
            taken[j] = 1
            matched.append(byte)
    common = len(matched)
    if not common:
        return 0.0
    opposite = (right[j] for j in range(m) if taken[j])
    moved = sum(a != b for a, b in zip(matched, opposite, strict=True)) // 2
    jaro = (common / n + common / m + (common - moved) / common) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for a, b in zip(left[:4], right[:4], strict=False):
        if a != b:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


#: Bytes of a text whose places fit into the bits of one number.
_PLACES = 64
#: Pairs that are matched together.
_TOGETHER = 4096


def _short_jaro_winkler(texts: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``_jaro_winkler`` of pairs of rows of texts that have 1 to 64 bytes, letter by letter."""
    length = np.array([len(t) for t in texts])
    padded = b"".join(t.ljust(_PLACES, b"\0") for t in texts)
    letter = np.frombuffer(padded, np.uint8).reshape(-1, _PLACES)
    held = np.arange(_PLACES) < length[:, None]
    used = np.unique(letter[held])
    code = np.zeros(256, np.int64)  # 0: no letter
    code[used] = np.arange(1, len(used) + 1)
    coded = np.where(held, code[letter], 0)
    places = np.zeros((len(texts), len(used) + 1), np.uint64)
    for k in range(length.max()):
        rows = np.flatnonzero(length > k)
        places[rows, coded[rows, k]] |= np.uint64(1 << k)
    width, places = places.shape[1], places.ravel()
    before = np.array([(1 << k) - 1 for k in range(_PLACES + 1)], np.uint64)
    result = np.empty(len(left))
    for at in range(0, len(left), _TOGETHER):
        a, b = left[at : at + _TOGETHER], right[at : at + _TOGETHER]
        n, m = length[a], length[b]
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        asked = coded[a].T + b * width
        taken, matched = np.zeros(len(a), np.uint64), np.zeros((_PLACES, len(a)), bool)
        for i in range(n.max()):
            near = before.take(i + reach + 1, mode="clip") & ~before.take(i - reach, mode="clip")
            free = places.take(asked[i]) & near & ~taken
            first = free & (~free + np.uint64(1))  # its lowest bit
            taken |= first
            matched[i] = first != 0
        matched = matched.T
        common = matched.sum(axis=1)
        bits = taken.astype("<u8")[:, None].view(np.uint8)
        opposite = np.unpackbits(bits, axis=1, bitorder="little").astype(bool)
        differs = letter[a][matched] != letter[b][opposite]
        pair = np.repeat(np.arange(len(a)), common)
        moved = np.bincount(pair[differs], minlength=len(a)) // 2
        jaro = (common / n + common / m + (common - moved) / np.maximum(common, 1)) / 3
        jaro = np.where(common > 0, jaro, 0.0)
        same = (letter[a, :4] == letter[b, :4]) & (np.arange(4) < np.minimum(n, m)[:, None])
        prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        raised = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
        result[at : at + len(a)] = np.where(a == b, 1.0, raised)
    return result


@F.pandas_udf(T.DoubleType())
def _jaro_winkler_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    known = (left.notna() & right.notna()).to_numpy()
    row_of: dict[str, int] = {}
    a, b = (
        np.array([row_of.setdefault(t, len(row_of)) for t in side[known]], np.int64)
        for side in (left, right)
    )
    texts = [t.encode() for t in row_of]
    fits = np.array([0 < len(t) <= _PLACES for t in texts], bool)
    short = fits[a] & fits[b]
    found = np.zeros(len(a))
    if short.any():
        rows = np.cumsum(fits) - 1
        some = [t for t in texts if 0 < len(t) <= _PLACES]
        found[short] = _short_jaro_winkler(some, rows[a[short]], rows[b[short]])
    met: dict[tuple[int, int], float] = {}
    for k in np.flatnonzero(~short):
        pair = (a[k], b[k])
        if pair not in met:
            met[pair] = _jaro_winkler(texts[pair[0]], texts[pair[1]])
        found[k] = met[pair]
    result = np.full(len(left), np.nan)
    result[known] = found
    return pd.Series(result).where(known, None)


def jaro_winkler(left: Column, right: Column) -> Column:
    """Jaro-Winkler similarity over UTF-8 bytes (Arrow batches; short texts all at once)."""
    return _jaro_winkler_batch(left, right)


# --- letters: what bounds the similarity of two texts without matching them -------------
#
# Jaro similarity counts m matched letters, so it is at most (m/a + m/b + 1) / 3 for texts of a
# and b bytes, and m is at most the number of letters they share, counted with repeats. Written
# as (letter, n-th occurrence) both texts are sets, and what they share is an intersection.

#: Bits of a letter token that hold the occurrence.
_OCCURRENCE = 40
#: Occurrences that a measured order tells apart; later ones are rare.
_MEASURED = 8
#: Text lengths fall into the same class if they differ by less than this factor.
_LENGTH_STEP = 1.25
#: Leading bytes that a pair shares: at least and at most.
_SHARED = ((0, 0), (1, 3), (4, 4))
_SLACK = 1e-9


def _letters(text: bytes) -> list[int]:
    seen: dict[int, int] = {}
    tokens = []
    for byte in text:
        n = seen[byte] = seen.get(byte, 0) + 1
        tokens.append(byte << _OCCURRENCE | n)
    return tokens


@F.pandas_udf(T.ArrayType(T.LongType()))
def _letters_batch(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _letters(t.encode()) for t in text], dtype=object)


def letters(text: Column) -> Column:
    """The bytes of a text as (byte, n-th occurrence) numbers, once per record."""
    return _letters_batch(text)


def letter_order(df, *columns: str) -> dict[int, int]:
    """Rows that hold each letter token, for the first occurrences; at most 2048 entries."""
    token = F.explode(F.array_distinct(F.concat(*[letters(F.col(c)) for c in columns])))
    known = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    counts = known.select(token.alias("token")).groupBy("token").count()
    early = counts.where(F.col("token").bitwiseAND(F.lit((1 << _OCCURRENCE) - 1)) <= _MEASURED)
    return {row["token"]: row["count"] for row in early.collect()}


def shared_letters(letters_left: Column, letters_right: Column) -> Column:
    """Number of letters two texts have in common, counted with repeats."""
    return F.size(F.array_intersect(letters_left, letters_right))


def jaro_winkler_bound(left: Column, right: Column, shared: Column) -> Column:
    """No less than the Jaro-Winkler similarity of texts with so many shared letters."""
    n, m = F.octet_length(left), F.octet_length(right)
    jaro = (shared / n + shared / m + F.lit(1.0)) / 3
    a, b = left.cast("binary"), right.cast("binary")
    prefix = F.lit(0)
    for k in range(1, 5):
        same = (n >= k) & (m >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
        prefix = F.when(same, F.lit(k)).otherwise(prefix)
    raised = jaro + F.when(jaro > 0.7, 0.1 * prefix * (1 - jaro)).otherwise(F.lit(0.0))
    known = left.isNotNull() & right.isNotNull()
    return F.when(known & (shared > 0), raised + _SLACK).when(known, F.lit(0.0))


def least_jaro(threshold: float, shared: int) -> float:
    """The lowest Jaro similarity that reaches the threshold with so many leading bytes shared."""
    if threshold <= 0.7:
        return threshold
    return max(0.7, (threshold - 0.1 * shared) / (1 - 0.1 * shared))


def _length_class(n: int) -> int:
    return int(math.log(n) / math.log(_LENGTH_STEP) + _SLACK)


def _needed(jaro: float, n: int, m: int) -> int:
    """Letters that texts of n and m bytes share at least if they reach the Jaro similarity."""
    return max(1, math.ceil((3 * jaro - 1) * n * m / (n + m) - _SLACK))


def _partners(jaro: float, n: int) -> list[tuple[int | None, int]]:
    """Length classes of possible partners, each with the shortest length it can have."""
    ratio = 3 * jaro - 2
    if ratio <= 0.05:
        return [(None, 1)]
    least, most = math.ceil(ratio * n - _SLACK), math.floor(n / ratio + _SLACK)
    found: dict[int | None, int] = {}
    for m in range(max(1, least), most + 1):
        found.setdefault(_length_class(m), m)
    return list(found.items())


def _text_keys(
    text: bytes, threshold: float, order: Mapping[int, int], tag: int, is_left: bool
) -> list[int]:
    n, keys = len(text), set()
    if not n:
        return []
    # A letter that no measured row has, or a late repeat, is the rarest; any one order is exact.
    tokens = sorted(_letters(text), key=lambda t: (order.get(t, 0), -(t % (1 << _OCCURRENCE)), -t))
    for shared, most in _SHARED:
        if n < shared:
            continue
        jaro = least_jaro(threshold, most)
        lead = int.from_bytes(text[:shared], "big")
        for partner, m in _partners(jaro, n):
            own = None if partner is None else _length_class(n)
            classes = (own, partner) if is_left else (partner, own)
            # If both sets share `needed` tokens, they share one of the first n - needed + 1.
            for token in tokens[: max(0, n - _needed(jaro, n, m) + 1)]:
                key = (tag, shared, lead, *(-1 if c is None else c for c in classes), token)
                keys.add(hash(key))  # hashes of whole numbers do not depend on the process
    return sorted(keys)


def similar_text_keys(
    text: Column,
    threshold: float,
    tag: str,
    is_left: bool,
    order: Mapping[int, int] | None = None,
) -> Column:
    """Keys of which any two texts at or above a Jaro-Winkler similarity share one.

    An inverted index over single letters with their repeats (longer grams may all be broken by
    transpositions, so they would lose pairs), cut by prefix and length filters; the number of
    leading bytes two texts share sets how alike the rest must be. One Arrow pass over records.
    """
    mark, ranks = zlib.crc32(f"{tag}:{threshold}".encode()), dict(order or {})

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(texts: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}
        for t in texts:
            if t is not None and t not in known:
                known[t] = _text_keys(t.encode(), threshold, ranks, mark, is_left)
        return pd.Series([known.get(t, []) for t in texts], dtype=object)

    return keys(text)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two equally long vectors; missing where one is all zero."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    return F.try_divide(dot(left, right), F.sqrt(dot(left, left) * dot(right, right)))
