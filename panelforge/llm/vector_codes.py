"""Vectors as short codes: one codebook for each part of the vector, entries found by Orchard search.

A component x counts as the integer floor(scale * x). Vectors are cut into equal consecutive
parts. The codebook of a part starts as that part of the vectors with the smallest ids; each
round gives every part its nearest entry and puts each entry in the middle of what it got.

Nearest entries come from Orchard search. Every entry has the list of the others by distance from
it. A search walks the list of its best entry so far; a nearer one (or one as near with a lower
index) is jumped to and its list begun; entries once measured are marked and passed over; beyond
twice the best distance no entry can be as near, so the search ends. All vectors of a batch walk
at once.

Vectors stay where they are: a task reads them in batches and gives sums and counts by entry and
position. Spark adds those up; only new codebooks (entries times components) pass the driver.

A row is dropped if its vector is null, empty, holds a null or non-finite component, or has not
the length of the vector with the smallest id, the first whose length can be cut evenly. Rows
without an id are coded but do not start an entry; repeated rows count as often as they occur, and
of rows with one id the least vector starts the entry. Fewer ids give fewer entries; no id at
all, no code and no error. Integers are exact at any size; errors beyond a long show as
the largest long. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.workers import release
from panelforge.sources.staging import stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
_MOST = (1 << 63) - 1
#: Exact sums travel as balanced digits of so many bits, each added up as a long.
_DIGIT = 40


def _floors(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 or, where too large for exact doubles, as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * float(scale))
    if not len(flat) or np.abs(scaled).max() < 2**52:
        return scaled.astype(np.int64)
    return np.array([scale * Fraction(x) // 1 for x in flat.tolist()], dtype=object)


def _exact(values: np.ndarray) -> np.ndarray:
    """values in a kind in which four times a squared distance is exact."""
    if values.dtype != object and values.size:
        most = max(abs(int(values.min())), abs(int(values.max())))
        if 4 * values.shape[-1] * (2 * most) ** 2 > _MOST:
            return values.astype(object)
    return values


@dataclass
class Codebook:
    """Entries of one part, with the lists that Orchard search walks."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        self.entries = _exact(self.entries)
        n = len(self.entries)
        apart = self._between(self.entries[:, None, :], self.entries[None, :, :])
        self.lists = np.zeros((n, max(0, n - 1)), dtype=np.int64)
        self.gaps = np.zeros(self.lists.shape, dtype=self.entries.dtype)
        for k in range(n):
            others = sorted((d, e) for e, d in enumerate(apart[k]) if e != k)
            self.lists[k] = [e for _, e in others]
            self.gaps[k] = [d for d, _ in others]
        spread = [int(c.max()) - int(c.min()) for c in self.entries.T]
        self.widest = int(np.argmax(np.array(spread, dtype=object)))

    @staticmethod
    def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a - b) ** 2).sum(axis=-1)

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower of equals) and the squared distance, by row."""
        values, entries = _exact(values), self.entries
        if values.dtype != entries.dtype:
            values, entries = values.astype(object), entries.astype(object)
        rows = np.arange(len(values))
        best = self._first(values, entries)
        error = self._between(values, entries[best])
        at = np.zeros(len(values), dtype=np.int64)
        marked = np.zeros((len(values), len(entries)), dtype=bool)
        marked[rows, best] = True
        while True:
            rows = rows[at[rows] < self.lists.shape[1]]
            gap = self.gaps[best[rows], at[rows]]
            rows = rows[(gap <= 4 * error[rows]).astype(bool)]
            if not len(rows):
                return best, error
            entry = self.lists[best[rows], at[rows]]
            at[rows] += 1
            fresh = ~marked[rows, entry]
            asked, entry = rows[fresh], entry[fresh]
            marked[asked, entry] = True
            found = self._between(values[asked], entries[entry])
            old = error[asked]
            nearer = ((found < old) | ((found == old) & (entry < best[asked]))).astype(bool)
            moved = asked[nearer]
            best[moved], error[moved], at[moved] = entry[nearer], found[nearer], 0

    def _first(self, values: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Where searches begin: the entry next above on the widest axis."""
        line = entries[:, self.widest]
        order = np.argsort(line, kind="stable")
        place = np.searchsorted(line[order], values[:, self.widest])
        return order[np.minimum(place, len(order) - 1)]


@dataclass
class Codebooks:
    """One codebook for each part; entries[part][entry] is a tuple of integers."""

    entries: list[list[tuple[int, ...]]]

    def digest(self) -> str:
        numbers = (str(x) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def ready(self) -> list[Codebook]:
        most = max((abs(x) for book in self.entries for e in book for x in e), default=0)
        kind = np.int64 if most < 2**62 else object
        return [Codebook(np.array(book, dtype=kind)) for book in self.entries]


def _cut(batch, width: int, parts: int, scale: int) -> np.ndarray:
    """Integers of a batch's vectors, as (rows, parts, width)."""
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    return _floors(flat, scale).reshape(len(batch), parts, width)


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a signed integer in base 2 ** _DIGIT, digits around zero."""
    place, half = 0, 1 << (_DIGIT - 1)
    while value:
        digit = (value + half) % (2 * half) - half
        if digit:
            yield place, digit
        value, place = (value - digit) >> _DIGIT, place + 1


def _gather(books: Codebooks, scale: int):
    """Function for mapInArrow: sums and counts of one task by part, entry and position."""

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ready = books.ready()
        parts, width = len(ready), len(books.entries[0][0])
        total: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            values = _cut(batch.column(0), width, parts, scale)
            for p, book in enumerate(ready):
                own = values[:, p]
                best, _ = book.nearest(own)
                for e in np.unique(best).tolist():
                    mine = own[best == e]
                    if mine.dtype != object and len(mine) * 2**52 > _MOST:
                        mine = mine.astype(object)
                    for at, n in enumerate([*mine.sum(axis=0).tolist(), len(mine)]):
                        total[p, e, at] = total.get((p, e, at), 0) + n
        rows = [(*key, place, d) for key, n in total.items() for place, d in _digits(n)]
        names = ["part", "entry", "position", "place", "digit"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        release()

    return gather


def _round(vectors: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """Codebooks whose entries lie in the middle of what was nearest to them."""
    sums = vectors.select("vector").mapInArrow(
        _gather(books, scale), "part long, entry long, position long, place long, digit long"
    )
    width = len(books.entries[0][0])
    found: dict[tuple[int, int], list[int]] = {}
    for r in sums.groupBy("part", "entry", "position", "place").agg(F.sum("digit").alias("d")).collect():
        line = found.setdefault((r.part, r.entry), [0] * (width + 1))
        line[r.position] += r.d << (_DIGIT * r.place)
    return Codebooks(
        [
            [
                tuple(x // line[-1] for x in line[:-1]) if (line := found.get((p, e))) else entry
                for e, entry in enumerate(book)
            ]
            for p, book in enumerate(books.entries)
        ]
    )


def _fit(vectors: DataFrame, vec_id: str, vector: str, label: str | None, parts: int) -> DataFrame:
    """Rows that can be coded, as (vec_id, label, vector of doubles)."""
    values = F.col(vector).cast("array<double>")
    sound = F.forall(
        values,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    size = F.size(values)
    kept = vectors.where(values.isNotNull() & (size > 0) & (size % parts == 0) & sound).select(
        F.col(vec_id).alias("vec_id"),
        (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
        values.alias("vector"),
    )
    kept = stage(kept, "vectors")
    sizes = kept.groupBy(F.size("vector").alias("size")).agg(F.min("vec_id").alias("least"))
    first = sizes.orderBy(F.col("least").asc_nulls_last(), "size").first()
    return kept.where(F.size("vector") == (first["size"] if first else 0))


def _start(fit: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    ids = fit.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id")
    least = [r.vec_id for r in ids.limit(entries).collect()]
    if not least:
        return None
    rows = fit.where(F.col("vec_id").isin(least)).groupBy("vec_id").agg(F.min("vector").alias("v"))
    vectors = [_floors(np.array(r.v), scale).tolist() for r in rows.orderBy("vec_id").collect()]
    width = len(vectors[0]) // parts
    return Codebooks(
        [[tuple(v[p * width : (p + 1) * width]) for v in vectors] for p in range(parts)]
    )


def _encode(fit: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    schema = T.StructType(
        [*fit.schema.fields[:2], T.StructField("code", T.StringType()),
         T.StructField("error", T.LongType())]
    )

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ready = books.ready()
        parts, width = len(ready), len(books.entries[0][0])
        for batch in batches:
            values = _cut(batch.column(2), width, parts, scale)
            codes = np.empty((len(values), parts), dtype=np.uint8)
            errors = np.zeros(len(values), dtype=object)
            for p, book in enumerate(ready):
                codes[:, p], error = book.nearest(values[:, p])
                errors += error.astype(object)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([row.tobytes().hex() for row in codes], pa.string()),
                    pa.array([min(e, _MOST) for e in errors.tolist()], pa.int64()),
                ],
                ["vec_id", "label", "code", "error"],
            )
        release()

    return fit.mapInArrow(encode, schema)


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error) for each vector that can be coded, the codebooks).

    code: the entry of each part in order, two hex digits each; error: the squared distances of
    all parts from their entries. entries: 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for a part, so 1 to 256 entries")
    fit = _fit(vectors, vec_id, vector, label, parts)
    books = _start(fit, parts, entries, scale)
    if books is None:
        none = F.lit(None)
        bare = fit.select(
            "vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error")
        )
        return bare, Codebooks([[] for _ in range(parts)])
    for _ in range(rounds):
        books = _round(fit, books, scale)
    return stage(_encode(fit, books, scale), "codes"), books


def with_group_error(coded: DataFrame, by: str = "label", name: str = "label_error") -> DataFrame:
    """coded with the errors added up over equal values of `by`, nulls together.

    The sums are stored first, so their measured size decides how they are joined.
    """
    sums = coded.groupBy(F.col(by).alias("__by")).agg(
        F.when(
            F.count("error") > 0, F.coalesce(F.try_sum("error"), F.lit(_MOST))
        ).alias(name)
    )
    sums = stage(sums, "errors")
    return coded.join(sums, coded[by].eqNullSafe(sums["__by"])).drop("__by")


def restored(code: Column, books: Codebooks, scale: int = SCALE) -> Column:
    """The vector a code stands for, in the middle of each integer's interval."""
    parts = []
    for p, book in enumerate(books.entries):
        table = F.array(*[F.array(*[F.lit((x + 0.5) / scale) for x in e]) for e in book])
        entry = F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
        parts.append(F.get(table, entry))
    return F.concat(*parts)
