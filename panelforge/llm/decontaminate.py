"""Benchmark decontamination with one FM-index per shard of training documents.

The test items are the query set: they are taken in blocks of a bounded number of words, each
broadcast. A task turns its documents into word numbers of the block's vocabulary; a word the
block does not have can be in no match and becomes a separator, and runs too short for any
window are left out. Over what remains of a shard it builds a suffix array, the
Burrows-Wheeler transform with a wavelet matrix over it, and every `SAMPLE`-th suffix position.
All windows are searched backwards at once, their occurrences located by walking to sampled
positions, and the hit words merged into spans. No shuffle; a lost task only repeats its shard.

Words are runs of digits, a-z (after lower-casing A-Z) and characters from U+0080. A window is
`window` consecutive words of an item, or the whole of a shorter item; an item without words has
none. Null texts have no words. Repeated items count once by their id; a missing id counts as
the empty string. Without items nothing is hit. Repeated documents are judged one by one;
input columns named like the results are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.workers import release

WINDOW = 10
#: Words of test items in one broadcast block.
BLOCK_WORDS = 1_000_000
#: Words of one index, and the distance of its sampled suffix positions.
SHARD_WORDS = 1 << 20
SAMPLE = 8

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
#: Byte map: lower case, and a space for every byte outside words.
_AS_WORDS = bytes(c if c in _WORD_BYTES else 32 for c in bytes(range(256)).lower())


def word_list(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_AS_WORDS).split()


class Block:
    """Windows of some items, over a vocabulary of their own."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, found in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(number[name])
        self.vocabulary = vocabulary
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.words = np.zeros((len(owners), window), dtype=np.int64)
        for k, found in enumerate(owners):
            self.words[k, : len(found)] = found
        sizes = [len(o) for o in owners.values()]
        self.item_at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.items = np.array([i for o in owners.values() for i in sorted(o)], dtype=np.int64)


def blocks_of(
    benchmark: DataFrame, item_id: str, text: str, window: int, most: int
) -> Iterator[Block]:
    """Blocks of at most `most` words (one item may exceed it), one on the driver at a time."""
    held: list[tuple[str, list[bytes]]] = []
    total = 0
    rows = benchmark.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.col(text).cast("binary").alias("text"),
    )
    for row in rows.toLocalIterator():
        found = word_list(bytes(row["text"]))
        if held and total + len(found) > most:
            yield Block(held, window)
            held, total = [], 0
        if found:
            held.append((row["item"], found))
            total += len(found)
    if held:
        yield Block(held, window)


def _suffix_array(rank: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; equal first symbols share a rank (from 0)."""
    size, step = len(rank), 1
    while True:
        second = np.zeros(size, dtype=np.int64)
        second[: size - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(size, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[order[-1]] == size - 1 or step >= size:
            return order
        rank, step = new, 2 * step


class FmIndex:
    """Backward search and locating over symbols 1, 2, ...; 0 separates and ends the text."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE) -> None:
        if not len(symbols) or symbols[-1] != 0:
            symbols = np.append(symbols, 0)
        apart = symbols == 0
        gaps = int(apart.sum())
        # each separator is a symbol of its own, below all words: comparisons end there
        first = np.where(apart, np.cumsum(apart) - 1, symbols + gaps - 1)
        order = _suffix_array(first)
        before = np.where(order > 0, symbols[order - 1], 0)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.highest = len(self.counts) - 2
        self.bits = max(1, int(self.highest).bit_length())
        self.before = before
        self.levels: list[tuple[np.ndarray, int]] = []
        current = before
        for level in reversed(range(self.bits)):
            ones = (current >> level) & 1
            ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            self.levels.append((ranks, len(current) - int(ranks[-1])))
            current = np.concatenate([current[ones == 0], current[ones == 1]])
        keep = (order % sample == 0) | (before == 0)
        self.sampled = np.where(keep, order, -1)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position, through the wavelet matrix."""
        start = np.zeros(len(at), dtype=np.int64)
        end = at.astype(np.int64)
        for level, (ranks, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            one = (symbol >> level) & 1 == 1
            start = np.where(one, ranks[start] + zeros, start - ranks[start])
            end = np.where(one, ranks[end] + zeros, end - ranks[end])
        return end - start

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pattern, low, high) of the patterns that occur."""
        alive = np.flatnonzero(lengths > 0)
        low = np.zeros(len(lengths), dtype=np.int64)
        high = np.full(len(lengths), len(self.before), dtype=np.int64)
        for step in range(words.shape[1]):
            moving = alive[lengths[alive] > step]
            done = alive[lengths[alive] <= step]
            symbol = words[moving, lengths[moving] - 1 - step]
            known = symbol <= self.highest
            moving, symbol = moving[known], symbol[known]
            low[moving] = self.counts[symbol] + self.rank(symbol, low[moving])
            high[moving] = self.counts[symbol] + self.rank(symbol, high[moving])
            alive = np.concatenate([done, moving[low[moving] < high[moving]]])
            if not len(alive):
                break
        return alive, low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows."""
        place = self.sampled[rows].astype(np.int64)
        todo = np.flatnonzero(place < 0)
        row, steps = rows[todo], 0
        while len(todo):
            symbol = self.before[row]
            row = self.counts[symbol] + self.rank(symbol, row)
            steps += 1
            found = self.sampled[row]
            here = found >= 0
            place[todo[here]] = found[here] + steps
            todo, row = todo[~here], row[~here]
        return place


def _occurrences(ids: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(position, window number) of every occurrence in ids, where 0 is no word of the block."""
    known = np.concatenate([[0], (ids != 0).astype(np.int8), [0]])
    change = np.diff(known)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long_enough = ends - starts >= block.lengths.min()
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    sizes = ends - starts + 1  # one separator behind each run
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    origin = np.arange(sizes.sum()) + np.repeat(starts - begin, sizes)
    symbols = np.append(ids, 0)[origin].astype(np.int64)
    symbols[begin + sizes - 1] = 0
    index = FmIndex(symbols)
    window, low, high = index.search(block.words, block.lengths)
    count = high - low
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = index.locate(np.repeat(low, count) + offset)
    return origin[place], np.repeat(window, count)


def _scan_shard(ids: np.ndarray, bounds: np.ndarray, block: Block):
    """Per document: (sorted item numbers, list of word spans)."""
    place, window = _occurrences(ids, block)
    delta = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(delta, place, 1)
    np.add.at(delta, place + block.lengths[window], -1)
    hit = np.concatenate([[0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]])
    change = np.diff(hit)
    span_start, span_end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    size = len(bounds) - 1
    items: list[list[int]] = [[] for _ in range(size)]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    owner = np.searchsorted(bounds, span_start, side="right") - 1
    for d, a, b in zip(owner, span_start - bounds[owner], span_end - bounds[owner], strict=True):
        spans[d].append((int(a), int(b)))
    pairs = np.unique(
        np.stack([np.searchsorted(bounds, place, side="right") - 1, window]), axis=1
    )
    count = block.item_at[pairs[1] + 1] - block.item_at[pairs[1]]
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item = block.items[np.repeat(block.item_at[pairs[1]], count) + offset]
    for d, i in np.unique(np.stack([np.repeat(pairs[0], count), item]), axis=1).T:
        items[d].append(int(i))
    return items, spans


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, touching ones joined."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ADDED = ("n_words", "n_hit", "items", "spans")


def _scan_batch(texts: list[bytes | None], block: Block, shard_words: int):
    """(n_words, items, spans) of each text."""
    get = block.vocabulary.get
    n_words: list[int] = []
    items: list[list[str]] = []
    spans: list[list[tuple[int, int]]] = []
    held: list[np.ndarray] = []
    total = 0

    def flush() -> None:
        nonlocal held, total
        if held:
            bounds = np.concatenate([[0], np.cumsum([len(h) for h in held])])
            found, at = _scan_shard(np.concatenate(held), bounds, block)
            items.extend([block.names[i] for i in f] for f in found)
            spans.extend(at)
        held, total = [], 0

    for text in texts:
        found = word_list(text)
        n_words.append(len(found))
        # one separator behind each document keeps matches inside it
        ids = np.zeros(len(found) + 1, dtype=np.int32)
        ids[:-1] = np.fromiter(map(get, found, repeat(0)), dtype=np.int32, count=len(found))
        held.append(ids)
        total += len(ids)
        if total >= shard_words:
            flush()
    flush()
    return n_words, items, spans


def _with_block(
    docs: DataFrame, text: str, block: Block | None, shard_words: int, cut: bool = False
) -> DataFrame:
    """docs with the block's findings merged into _ADDED; with cut, all spans are removed."""
    kept = [f for f in docs.schema.fields if f.name not in _ADDED]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            *kept,
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", T.ArrayType(span)),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = [f.name for f in kept]
    again = set(_ADDED) <= set(docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            if held is None:
                n_words = [len(word_list(t)) for t in texts]
                items: list[list[str]] = [[] for _ in texts]
                spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            else:
                n_words, items, spans = _scan_batch(texts, held, shard_words)
            if again:
                older = batch.column("items").to_pylist()
                items = [sorted({*a, *b}) for a, b in zip(older, items, strict=True)]
                older = batch.column("spans").to_pylist()
                spans = [
                    _merge([*((s["start"], s["end"]) for s in a), *b])
                    for a, b in zip(older, spans, strict=True)
                ]
            n_hit = [sum(b - a for a, b in s) for s in spans]
            as_dicts = [[{"start": a, "end": b} for a, b in s] for s in spans]
            columns = {n: batch.column(n) for n in names}
            if cut and any(spans):
                left = [_cut(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                columns[text] = pa.array(left, pa.binary()).cast(columns[text].type)
            yield pa.RecordBatch.from_arrays(
                [columns[n] for n in names]
                + [
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(as_dicts, pa.list_(_SPAN)),
                ],
                names=[*names, *_ADDED],
            )
        release()

    return docs.mapInArrow(scan, schema)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    cut: bool = False,
) -> DataFrame:
    """docs with n_words, n_hit, items (ids, sorted) and spans (hit words, from start to end).

    With cut, the text comes without its spans; the counts remain those of the text as it was.
    """
    found, held = docs.drop(*_ADDED), None
    for block in blocks_of(benchmark, item_id, item_text, window, block_words):
        if held is not None:
            found = _with_block(found, text, held, shard_words)
        held = block
    return _with_block(found, text, held, shard_words, cut)


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """data without the words of the spans and what stands between them."""
    inside = np.frombuffer(data.translate(_AS_WORDS), dtype=np.uint8) != 32
    change = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    kept, at = [], 0
    for first, last in spans:
        kept.append(data[at : starts[first]])
        at = ends[last - 1]
    kept.append(data[at:])
    return b"".join(kept)
