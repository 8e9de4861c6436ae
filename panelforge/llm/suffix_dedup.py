"""Removal of byte strings that an earlier document already has, by sharded suffix arrays.

A byte is removed if a string of `LENGTH` bytes that covers it also starts in a document with
a smaller id. Every such string (a window) is dealt to a shard by the least hash of the grams
inside it, so equal windows meet, however their surroundings differ; neighbouring windows
mostly share that gram and travel as one context.

1. Contexts are announced to their shard by the gram's hash and their number in the text. A
   shard answers which hashes occur in several documents; only those contexts can hold a
   repeated window.
2. The contexts asked for are cut out of the texts and sent to their shard. Equal contexts are
   merged; if all contexts of a hash are equal, so are their documents' windows, and the least
   id of the context decides. For the others the shard's suffix array is induced and its
   permuted common prefixes are computed. Neighbours that share a whole window form a class;
   its least document id decides for every occurrence.
3. The removed ranges go back to their documents, are united and cut out.

Texts travel compressed, three times in all; hashes and ranges are packed arrays. Shards and
buckets grow in number with the input, and a shard sorts its contexts in parts of bounded size
(all contexts of one gram in one part). Equal contexts of a task are sent once, so that a
passage in a third of all documents costs its shard one text and a list of places.

Null and short texts lose nothing. Rows that share an id never remove from each other. Rows
without an id are the last of all. Ties cannot occur: only smaller ids count, and all removals
are judged on the input. Extra columns pass through; columns named like the results are
replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.induced_sorting import permuted_prefixes, suffix_array
from panelforge.llm.workers import release

LENGTH = 50
#: Bytes of a gram, a multiple of 8; a window holds LENGTH - GRAM + 1 of them.
GRAM = 16
#: Input bytes behind one shard and one bucket, and bytes that a shard sorts at once.
SHARD_BYTES = 8 << 20
PART_BYTES = 2 << 20
LEAST_SHARDS = 64
_PIECE = 1 << 20
_LAST = np.iinfo(np.int64).max


def _u64(value: int) -> np.uint64:
    return np.uint64(value)


#: Odd multipliers of the gram hash.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _u64(32))
    x = x * _u64(_MIX[3])
    return x ^ (x >> _u64(29))


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob."""
    import zstandard

    parts = [struct.pack("<I", len(arrays))]
    for array in arrays:
        parts.append(struct.pack("<2sQ", array.dtype.str[1:].encode(), array.size))
        parts.append(array.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    at, found = 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind, size = struct.unpack_from("<2sQ", data, at)
        dtype = np.dtype(kind.decode())
        found.append(np.frombuffer(data, dtype=dtype, count=size, offset=at + 10))
        at += 10 + size * dtype.itemsize
    return found


def contexts(
    data: np.ndarray, owner: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> tuple[np.ndarray, ...]:
    """(start, windows, hash) of the runs of windows that share their least gram hash.

    owner tells the text of each byte; windows that reach into another text are left out.
    """
    size = len(data)
    if size < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << _u64(8 * width)
    grams = np.zeros(size - gram + 1, dtype=np.uint64)
    for k in range(0, gram, 8):
        part = x[k : k + len(grams)]
        grams = _mixed((grams ^ part) * _u64(_MIX[k // 8 % 3]))
    least, have, wanted = grams, 1, length - gram + 1
    while 2 * have <= wanted:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < wanted:
        gap = wanted - have
        least = np.minimum(least[:-gap], least[gap:])
    valid = owner[: len(least)] == owner[length - 1 :]
    begins = valid.copy()
    begins[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]))
    goes_on = np.zeros(len(valid) + 1, dtype=bool)
    goes_on[:-1] = valid & ~begins
    start = np.flatnonzero(begins)
    stops = np.flatnonzero(~goes_on)
    windows = stops[np.searchsorted(stops, start, side="right")] - start
    return start, windows, least[start]


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text number of each byte, start of each text's piece) in pieces of bounded size.

    A long text is cut where windows of one piece end and those of the next begin.
    """
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), _PIECE):
            held.append((k, at, text[at : at + _PIECE + LENGTH - 1]))
            total += len(held[-1][2])
            if total >= _PIECE:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    sizes = [len(h[2]) for h in held]
    data = np.frombuffer(b"".join(h[2] for h in held), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    number = np.array([h[0] for h in held], dtype=np.int64)
    shift = np.array([h[1] for h in held], dtype=np.int64) - begin
    # pieces of one text are told apart too: windows must not span two of them
    piece = np.repeat(np.arange(len(held)), sizes)
    return data, piece, number, shift


def _deal(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, hash) of all contexts."""
    found: list[tuple[np.ndarray, ...]] = []
    for data, piece, number, shift in _pieces(texts):
        start, windows, hashed = contexts(data, piece)
        own = piece[start]
        found.append((number[own], start + shift[own], windows, hashed))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _bucket(doc: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    key = doc.astype(np.int64).view(np.uint64) * _u64(_MIX[0]) ^ tag.astype(np.uint64)
    return (_mixed(key) >> _u64(16)).astype(np.int64) % buckets


def _grouped(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions in order) for each value of key."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    edges = np.flatnonzero(np.diff(ordered)) + 1
    for part in np.split(order, edges) if len(order) else []:
        yield int(key[part[0]]), part


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _tags(texts: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(t) for t in texts], dtype=np.uint32)


def _ordinals(number: np.ndarray) -> np.ndarray:
    """Place of each context among those of its text; number is ascending."""
    first = np.searchsorted(number, number, side="left")
    return np.arange(len(number)) - first


def _announce(shards: int):
    """Batches of (doc, text) to (shard, blob of doc, tag, runs, ordinal, hash)."""

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = _texts(batch.column(1)), _ids(batch.column(0))
            tags = _tags(texts)
            number, _, _, hashed = _deal(texts)
            ordinal = _ordinals(number)
            shard = (hashed >> _u64(32)).astype(np.int64) % shards
            keys, blobs = [], []
            for key, at in _grouped(shard):
                own, counts = np.unique(number[at], return_counts=True)
                keys.append(key)
                blobs.append(
                    pack(
                        docs[own],
                        tags[own],
                        counts.astype(np.uint32),
                        np.diff(ordinal[at], prepend=0).astype(np.int32),
                        hashed[at].astype(np.uint32),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"]
            )
        release()

    return announce


def _shared(buckets: int):
    """Announced contexts of a shard whose hash has several documents, by bucket."""

    def shared(key, rows: pd.DataFrame) -> pd.DataFrame:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for blob in rows["blob"]:
            doc, tag, counts, step, hashed = unpack(blob)
            held = (np.repeat(doc, counts), np.repeat(tag, counts), np.cumsum(step), hashed)
            for column, part in zip(columns, held, strict=True):
                column.append(part)
        doc, tag, ordinal, hashed = (np.concatenate(c) for c in columns)
        order = np.argsort(hashed, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(hashed[order])) + 1])
        least = np.minimum.reduceat(doc[order], edges)
        most = np.maximum.reduceat(doc[order], edges)
        sizes = np.diff(np.append(edges, len(order)))
        wanted = np.zeros(len(doc), dtype=bool)
        wanted[order] = np.repeat(least < most, sizes)
        at = np.flatnonzero(wanted)
        out = []
        for bucket, part in _grouped(_bucket(doc[at], tag[at], buckets)):
            part = at[part]
            part = part[np.lexsort((ordinal[part], tag[part], doc[part]))]
            step = np.diff(ordinal[part], prepend=0).astype(np.int32)
            shard = np.full(1, key[0], dtype=np.int32)
            out.append((bucket, pack(shard, doc[part], tag[part], step)))
        return pd.DataFrame(out, columns=["bucket", "blob"])

    return shared


def _bundled(buckets: int):
    """Batches of (doc, text) to (bucket, blob of doc, tag, size, texts)."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = _texts(batch.column(1)), _ids(batch.column(0))
            tags = _tags(texts)
            keys, blobs = [], []
            for key, at in _grouped(_bucket(docs, tags, buckets)):
                own = [texts[k] for k in at]
                size = np.array([len(t) for t in own], dtype=np.int64)
                body = np.frombuffer(b"".join(own), dtype=np.uint8)
                keys.append(key)
                blobs.append(pack(docs[at], tags[at], size, body, level=3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"]
            )
        release()

    return bundle


def _pressed(buckets: int, doc_id: str, text: str, names: list[str]):
    """Batches with bucket, document key and the compressed text in front of kept columns."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts, docs = _texts(batch.column(text)), _ids(batch.column(doc_id))
            tags = _tags(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_bucket(docs, tags, buckets), pa.int64()),
                    pa.array(docs, pa.int64()),
                    pa.array(tags.astype(np.int64), pa.int64()),
                    pa.array([compressor.compress(t) for t in texts], pa.binary()),
                    *[batch.column(n) for n in names],
                ],
                names=["bucket", "__doc", "__tag", "__text", *names],
            )

    return press


def _unpress(data) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(bytes(data))


def _cut_out(key, docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The contexts asked for, as (shard, blob)."""
    by_shard: dict[int, list] = {}
    needed: set[tuple[int, int]] = set()
    for blob in asked["blob"]:
        shard, doc, tag, step = unpack(blob)
        by_shard.setdefault(int(shard[0]), []).append((doc, tag, np.cumsum(step)))
        needed.update(zip(doc.tolist(), tag.tolist(), strict=True))
    place: dict[tuple[int, int], int] = {}
    texts: list[bytes] = []
    for blob in docs["blob"]:
        doc, tag, size, body = unpack(blob)
        body, end = body.tobytes(), np.cumsum(size).tolist()
        for k, name in enumerate(zip(doc.tolist(), tag.tolist(), strict=True)):
            if name in needed and name not in place:
                place[name] = len(texts)
                texts.append(body[end[k] - int(size[k]) : end[k]])
    number, start, windows, hashed = _deal(texts)
    first = np.searchsorted(number, np.arange(len(texts)))
    out = []
    for shard, parts in by_shard.items():
        doc, tag, ordinal = (np.concatenate(c) for c in zip(*parts, strict=True))
        own = [place[n] for n in zip(doc.tolist(), tag.tolist(), strict=True)]
        at = first[own] + ordinal
        known: dict[bytes, int] = {}
        name = np.array(
            [
                known.setdefault(texts[k][a : a + n + LENGTH - 1], len(known))
                for k, a, n in zip(own, start[at].tolist(), windows[at].tolist(), strict=True)
            ],
            dtype=np.uint32,
        )
        _, one = np.unique(name, return_index=True)
        sizes = np.array([len(c) for c in known], dtype=np.uint32)
        body = np.frombuffer(b"".join(known), dtype=np.uint8)
        low = hashed[at[one]].astype(np.uint32)
        out.append((shard, pack(doc, tag, start[at], name, sizes, low, body, level=3)))
    return pd.DataFrame(out, columns=["shard", "blob"])


def _least_ids(pieces: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least document id of every window of the contexts, and where each context begins."""
    sizes = np.array([len(p) + 1 for p in pieces])
    begin = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join([*pieces, b""]), dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[begin + sizes - 1] = 0
    order = suffix_array(symbols, 257, LENGTH)
    shared = permuted_prefixes(symbols, order, LENGTH)
    left = begin + sizes - 1
    room = np.repeat(left, sizes) - np.arange(len(symbols))
    windows = order[room[order] >= LENGTH]
    edges = np.flatnonzero(shared[windows] < LENGTH)
    edges = np.union1d(edges, [0])
    owner = np.repeat(np.arange(len(pieces)), sizes)
    lowest = np.minimum.reduceat(least[owner[windows]], edges)
    found = np.full(len(symbols), _LAST, dtype=np.int64)
    found[windows] = np.repeat(lowest, np.diff(np.append(edges, len(windows))))
    return found, begin


def _parts(numbers: list[int], hashed: list[int], sizes: np.ndarray) -> Iterator[list[int]]:
    """Context numbers in parts of about PART_BYTES; equal hashes stay together."""
    held, total, before = [], 0, None
    for k in sorted(numbers, key=hashed.__getitem__):
        if total >= PART_BYTES and hashed[k] != before:
            yield held
            held, total = [], 0
        held.append(k)
        total += sizes[k]
        before = hashed[k]
    if held:
        yield held


def _repeated(buckets: int):
    """Ranges that the documents of a shard lose, by bucket."""

    def repeated(key, rows: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        hashes: list[int] = []
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for blob in rows["blob"]:
            doc, tag, start, number, sizes, hashed, body = unpack(blob)
            body, at = body.tobytes(), 0
            mapped = np.empty(len(sizes), dtype=np.int64)
            for k, n in enumerate(sizes.tolist()):
                piece = body[at : at + n]
                at += n
                mapped[k] = known.setdefault(piece, len(known))
                if mapped[k] == len(hashes):
                    hashes.append(int(hashed[k]))
            for column, part in zip(columns, (doc, tag, start, mapped[number]), strict=True):
                column.append(part)
        doc, tag, start, number = (np.concatenate(c) for c in columns)
        pieces = list(known)
        least = np.full(len(pieces), _LAST, dtype=np.int64)
        np.minimum.at(least, number, doc)
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(len(pieces) + 1))
        out: list[list[np.ndarray]] = [[], [], [], []]
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        # equal windows have equal hashes, so a context alone under its hash needs no sorting
        _, group, members = np.unique(
            np.array(hashes, dtype=np.uint32), return_inverse=True, return_counts=True
        )
        alone = members[group] == 1
        gone = np.flatnonzero(alone[number] & (least[number] < doc))
        first = (doc[gone], tag[gone], start[gone], start[gone] + lengths[number[gone]])
        for column, part in zip(out, first, strict=True):
            column.append(part)
        for part in _parts(np.flatnonzero(~alone).tolist(), hashes, lengths):
            chosen = np.array(part)
            lowest, begin = _least_ids([pieces[k] for k in part], least[chosen])
            sizes = bounds[chosen + 1] - bounds[chosen]
            offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            use = order[np.repeat(bounds[chosen], sizes) + offset]
            base = np.repeat(begin, sizes)
            windows = np.repeat(lengths[chosen] - LENGTH + 1, sizes)
            for at in range(0, len(use), 1 << 16):
                found = _ranges(
                    lowest, base[at : at + (1 << 16)], windows[at : at + (1 << 16)],
                    doc[use[at : at + (1 << 16)]], start[use[at : at + (1 << 16)]],
                )
                row = use[at : at + (1 << 16)][found[0]]
                for column, piece in zip(out, (doc[row], tag[row], *found[1:]), strict=True):
                    column.append(piece)
        doc, tag, begins, ends = (np.concatenate(c) for c in out)
        made = []
        for bucket, part in _grouped(_bucket(doc, tag, buckets)):
            part = part[np.lexsort((begins[part], tag[part], doc[part]))]
            made.append(
                (bucket, pack(doc[part], tag[part], begins[part], (ends - begins)[part].astype(np.uint32)))
            )
        release()
        return pd.DataFrame(made, columns=["bucket", "blob"])

    return repeated


def _ranges(lowest, base, windows, doc, start) -> tuple[np.ndarray, ...]:
    """(occurrence, start, end) of the bytes covered by windows with a smaller id."""
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    own = np.repeat(np.arange(len(windows)), windows)
    gone = lowest[base[own] + offset] < doc[own]
    begins = gone.copy()
    begins[1:] &= ~gone[:-1] | (own[1:] != own[:-1])
    ends = gone.copy()
    ends[:-1] &= ~gone[1:] | (own[1:] != own[:-1])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    row = own[first]
    return row, start[row] + offset[first], start[row] + offset[last] + LENGTH


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open ranges; touching ones are one run."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(begin), dtype=bool)
    fresh[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return begin[first], reach[np.append(first[1:], len(begin)) - 1]


_RESULT = ("kept", "n_bytes", "n_removed", "n_spans")


def _remove(names: list[str], decode: bool):
    """Rows of a bucket without the ranges they lose."""

    def remove(key, docs: pd.DataFrame, lost: pd.DataFrame) -> pd.DataFrame:
        if docs.empty:
            return pd.DataFrame(columns=[*names, *_RESULT])
        ranges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if len(lost):
            columns = [unpack(b) for b in lost["blob"]]
            doc, tag, begin, size = (np.concatenate(c) for c in zip(*columns, strict=True))
            order = np.lexsort((tag, doc))
            edges = np.flatnonzero(np.diff(doc[order]) | np.diff(tag[order].astype(np.int64))) + 1
            for part in np.split(order, edges):
                ranges[int(doc[part[0]]), int(tag[part[0]])] = _union(
                    begin[part], begin[part] + size[part].astype(np.int64)
                )
        kept, totals, removed, spans = [], [], [], []
        for d, t, pressed in zip(docs["__doc"], docs["__tag"], docs["__text"], strict=True):
            data = _unpress(pressed)
            begin, end = ranges.get((d, t), ((), ()))
            parts, at = [], 0
            for a, b in zip(begin, end, strict=True):
                parts.append(data[at:a])
                at = b
            parts.append(data[at:])
            kept.append(b"".join(parts))
            totals.append(len(data))
            removed.append(len(data) - len(kept[-1]))
            spans.append(len(begin))
        if decode:
            kept = [k.decode("utf-8", "ignore") for k in kept]
        out = docs[names].copy()
        return out.assign(kept=kept, n_bytes=totals, n_removed=removed, n_spans=spans)

    return remove


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", decode: bool = False
) -> DataFrame:
    """docs without text, with kept (bytes left), n_bytes, n_removed and n_spans.

    With decode, kept is a string; characters of which only a part is left are dropped.
    """
    fields = [f for f in docs.schema.fields if f.name not in (*_RESULT, text)]
    names = [f.name for f in fields]
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    pair = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    place = "bucket long, blob binary"
    kept = T.StructType(
        [
            T.StructField("bucket", T.LongType()),
            T.StructField("__doc", T.LongType()),
            T.StructField("__tag", T.LongType()),
            T.StructField("__text", T.BinaryType()),
        ]
    )
    bare = pair.mapInArrow(_bundled(shards), place)
    asked = (
        pair.mapInArrow(_announce(shards), "shard int, blob binary")
        .groupBy("shard")
        .applyInPandas(_shared(shards), place)
    )
    ranges = (
        bare.groupBy("bucket")
        .cogroup(asked.groupBy("bucket"))
        .applyInPandas(_cut_out, "shard int, blob binary")
        .groupBy("shard")
        .applyInPandas(_repeated(shards), place)
    )
    full = docs.mapInArrow(_pressed(shards, doc_id, text, names), T.StructType([*kept, *fields]))
    result = T.StructType(
        [
            *fields,
            T.StructField("kept", T.StringType() if decode else T.BinaryType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
        ]
    )
    return (
        full.groupBy("bucket")
        .cogroup(ranges.groupBy("bucket"))
        .applyInPandas(_remove(names, decode), result)
    )
