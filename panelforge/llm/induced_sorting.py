"""Suffix arrays by induced sorting, with whole buckets moved at a time.

The classical algorithm scans the suffix array entry by entry. Entries of one first-symbol
bucket that are known when the scan reaches it can be moved together, so here the scan goes
bucket by bucket, and within a bucket in waves (one per repetition of the symbol).
"""

from __future__ import annotations

import numpy as np


def classify(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is smaller-type, positions of leftmost-smaller suffixes); an end symbol is implied.

    A suffix is smaller-type if it sorts before the suffix one to its right. The implied end
    sorts before everything, so the last suffix is larger-type.
    """
    size = len(symbols)
    following = np.full(size, -1, dtype=np.int32)
    following[:-1] = symbols[1:]
    here = symbols.astype(np.int32)
    differs = here != following
    # the next position whose symbol differs from its neighbour decides for the whole run
    marks = np.where(differs, np.arange(size), size)
    nearest = np.minimum.accumulate(marks[::-1])[::-1]
    smaller = here[nearest] < following[nearest]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, lms


def _place(order: np.ndarray, keys: np.ndarray, edge: np.ndarray, step: int, out: np.ndarray):
    """Append entries to the buckets of their keys, from edge in the direction of step."""
    sort = np.argsort(keys, kind="stable")
    counts = np.bincount(keys, minlength=len(edge))
    begin = np.cumsum(counts) - counts
    sorted_keys = keys[sort]
    rank = np.arange(len(keys)) - begin[sorted_keys]
    out[edge[sorted_keys] + step * rank] = order[sort]
    edge += step * counts


def induce(symbols: np.ndarray, smaller: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix order induced from the order in which the leftmost-smaller suffixes are given."""
    size = len(symbols)
    counts = np.bincount(symbols, minlength=alphabet)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.full(size, -1, dtype=np.int32)

    # leftmost-smaller suffixes by bucket, in the order given
    keys = symbols[lms]
    by_bucket = lms[np.argsort(keys, kind="stable")]
    lms_counts = np.bincount(keys, minlength=alphabet)
    lms_begin = np.cumsum(lms_counts) - lms_counts

    # larger-type suffixes, buckets upwards; the implied end induces the last suffix first
    edge = starts.copy()
    out[edge[symbols[-1]]] = size - 1
    edge[symbols[-1]] += 1
    for bucket in np.flatnonzero(counts):
        at = starts[bucket]
        while at < edge[bucket]:
            wave = out[at : edge[bucket]]
            at = edge[bucket]
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _place(before, symbols[before], edge, 1, out)
        if lms_counts[bucket]:
            a = lms_begin[bucket]
            before = by_bucket[a : a + lms_counts[bucket]] - 1  # larger-type by definition
            _place(before, symbols[before], edge, 1, out)

    # smaller-type suffixes, buckets downwards
    top = ends - 1
    for bucket in np.flatnonzero(counts)[::-1]:
        at = ends[bucket] - 1
        while at > top[bucket]:
            wave = out[top[bucket] + 1 : at + 1][::-1]
            at = top[bucket]
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _place(before, symbols[before], top, -1, out)
        wave = out[starts[bucket] : edge[bucket]][::-1]  # its larger-type part
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _place(before, symbols[before], top, -1, out)
    return out


def _names(symbols: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Name (rank from 0) of each leftmost-smaller substring, in text order."""
    size = len(symbols)
    length = np.empty(size, dtype=np.int32)
    length[lms] = np.append(lms[1:], size) - lms + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    # a substring that reaches the end of the text has no equal
    same &= (a + length[a] <= size) & (b + length[b] <= size)
    active = np.flatnonzero(same)
    offset = 0
    while len(active):
        x, y = a[active], b[active]
        equal = symbols[x + offset] == symbols[y + offset]
        same[active[~equal]] = False
        active = active[equal & (offset + 1 < length[x])]
        offset += 1
    rank = np.empty(size, dtype=np.int32)
    rank[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return rank[lms]


def _order_of_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the reduced text by their first `depth` names at least.

    Pairs of ranks are renamed until all differ or the depth is reached.
    """
    rank, step = names.astype(np.int64), 1
    size = len(rank)
    order = np.argsort(rank)
    while step < depth and size > 1 and rank.max() < size - 1:
        second = np.zeros(size, dtype=np.int64)
        second[: size - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
    return order


def suffix_array(symbols: np.ndarray, alphabet: int, depth: int | None = None) -> np.ndarray:
    """Order of all suffixes of symbols (0 .. alphabet - 1).

    With a depth, suffixes that agree in that many symbols may come in any order.
    """
    size = len(symbols)
    if size < 2:
        return np.arange(size, dtype=np.int32)
    smaller, lms = classify(symbols)
    lms = lms.astype(np.int32)
    if len(lms) > 1:
        rough = induce(symbols, smaller, lms, alphabet)
        is_lms = np.zeros(size, dtype=bool)
        is_lms[lms] = True
        names = _names(symbols, lms, rough[is_lms[rough]])
        # a leftmost-smaller substring spans two symbols at least
        lms = lms[_order_of_names(names, size if depth is None else depth // 2 + 1)]
    return induce(symbols, smaller, lms, alphabet)


def permuted_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For every text position, the common prefix (up to `most`) with its predecessor in order.

    Computed in text order, four 16-bit symbols at a time.
    """
    size = len(symbols)
    shared = np.zeros(size, dtype=np.int32)
    padded = np.full(size + most + 8, 0xFFFF, dtype=np.uint64)
    padded[:size] = symbols
    pairs = padded[:-1] | padded[1:] << np.uint64(16)
    words = pairs[:-2] | pairs[2:] << np.uint64(32)
    here = np.sort(order[1:])
    previous = np.empty(size, dtype=np.int32)
    previous[order[1:]] = order[:-1]
    there = previous[here]
    for offset in range(0, most, 4):
        differs = words[here + offset] ^ words[there + offset]
        equal = differs == 0
        stop = here[~equal]
        last = differs[~equal]
        shared[stop] = offset + np.bitwise_count((last & -last) - np.uint64(1)) // 16
        here, there = here[equal], there[equal]
        if not len(here):
            break
    shared[here] = most
    return np.minimum(shared, most)
