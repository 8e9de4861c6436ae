"""Records of CSV files of any size, with line breaks in quoted fields, read by many tasks.

A line says where it ends only if one knows whether it began inside a quoted field. So byte ranges
are scanned twice. First each range tells in which state it ends, for both states in which it may
begin; these small functions compose along the file and give every range its true beginning. Then
lines are joined into records; what crosses the edge of a range (one record each at most) is put
together from the lines that the first scan names. That scan also gives the headers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields that begin outside quotes, with their commas. A quote counts at a field's start only.
_FIELDS = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+')
_CLOSED = re.compile(r'"(?:[^"]++|"")*+"')
_REST_OF_QUOTED = re.compile(r'(?:[^"]++|"")*+"[^,]*+(?:,|$)')
_WHOLE, _OPEN, _TAIL = 0, 1, 2


def ends_in_quotes(line: str, in_quotes: bool) -> bool:
    """Whether the line's end lies in a quoted field, given whether its beginning does."""
    if '"' not in line:
        return in_quotes
    at = 0
    if in_quotes:
        rest = _REST_OF_QUOTED.match(line)
        if rest is None:
            return True
        at = rest.end()
        if line[at - 1] != ",":
            return False
    at = _FIELDS.match(line, at).end()
    return line.startswith('"', at) and _CLOSED.match(line, at) is None


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(files).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _ranges(batches: Iterator) -> Iterator[tuple[tuple[str, int], object]]:
    """((file, start), Arrow lines of one batch); a range may come in several batches, in order."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = {
            end
            for k in (1, 2)
            for end in pc.run_end_encode(batch.column(k), run_end_type="int64").run_ends.to_pylist()
        }
        low = 0
        for high in sorted(ends):
            key = batch.column(1)[low].as_py(), batch.column(2)[low].as_py()
            yield key, batch.column(0).slice(low, high - low)
            low = high


def _batch(names: str, kinds: tuple, rows: list):
    import pyarrow as pa

    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names.split()
    )


class _Scan:
    """What a range's lines make of it, if it begins outside (0) or inside (1) quotes."""

    def __init__(self):
        self.lines = 0
        self.states = [False, True]
        self.begins = [0, 0]  # line at which the record that is not over yet begins
        self.tail = None  # lines up to the end of the record that came in, if inside
        self.head = None  # first record, if outside
        self.held = []

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self.lines += 1
            for k in (0, 1):
                self.states[k] = ends_in_quotes(line, self.states[k])
                if not self.states[k]:
                    self.begins[k] = self.lines
            if self.tail is None and not self.states[1]:
                self.tail = self.lines
            if self.held is not None:
                self.held.append(line)
                if not self.states[0]:
                    self.head, self.held = "\n".join(self.held), None


_END_COLUMNS = (
    "file string, start long, lines long, outside boolean, inside boolean, open_outside long, "
    "open_inside long, tail long, head string"
)


def _ends(batches: Iterator) -> Iterator:
    """The scan of each range; its first record only where that begins the file."""
    import pyarrow as pa

    found: dict[tuple[str, int], _Scan] = {}
    for key, lines in _ranges(batches):
        scan = found.get(key)
        if scan is None:
            scan = found[key] = _Scan()
            if key[1] != 0:
                scan.held = None
        scan.add(lines.to_pylist())
    rows = [
        (*key, s.lines, *s.states, *s.begins, s.lines if s.tail is None else s.tail, s.head)
        for key, s in found.items()
    ]
    names = "file start lines outside inside open_outside open_inside tail head"
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 3, pa.string())
    yield _batch(names, kinds, rows)


def _scanned(lines: DataFrame) -> tuple[set, dict, dict]:
    """Ranges that begin in a quoted field; lines at the edges of ranges; first records of files.

    Edges: lines that end a record of the range before, and the line at which one begins that the
    range does not end. Ranges are as few as input splits.
    """
    inside, edges, heads, file, state = set(), {}, {}, None, False
    scans = lines.mapInArrow(_ends, _END_COLUMNS)
    for row in scans.orderBy("file", "start").toLocalIterator():
        key = (row.file, row.start)
        state = state if row.file == file else False
        file = row.file
        tail = row.tail if state else 0
        if state:
            inside.add(key)
        if row.start == 0:
            heads[file] = row.head
        begins = row.open_inside if state else row.open_outside
        state = row.inside if state else row.outside
        opened = begins if state and begins >= tail and begins < row.lines and (begins or not tail) else None
        if tail or opened is not None:
            edges[key] = (tail, opened)
    return inside, edges, heads


_PIECES = "file string, start long, at long, kind int, text string"


def _pieces(key: tuple[str, int], rows: list[tuple[int, int, str]]):
    import pyarrow as pa

    at, kind, text = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(key[0], pa.string()), len(rows)),
            pa.repeat(pa.scalar(key[1], pa.int64()), len(rows)),
            pa.array(at, pa.int64()),
            pa.array(kind, pa.int32()),
            pa.array(text, pa.string()),
        ],
        ["file", "start", "at", "kind", "text"],
    )


def _join_lines(inside: set[tuple[str, int]], quoted: bool):
    """Function for mapInArrow: the records that begin and end in a range."""

    def join(batches: Iterator) -> Iterator:
        key, held, at, state, tail, rows = None, [], 0, False, False, []
        for range_key, lines in _ranges(batches):
            if range_key != key:
                if rows:
                    yield _pieces(key, rows)
                key, at, state, held, rows = range_key, 0, range_key in inside, [], []
                tail = state
            for line in lines.to_pylist():
                held.append(line)
                state = quoted and ends_in_quotes(line, state)
                if not state:
                    if not tail:
                        rows.append((at, _WHOLE, "\n".join(held) if len(held) > 1 else line))
                    at, held, tail = at + 1, [], False
            if len(rows) >= 5000:
                yield _pieces(key, rows)
                rows = []
        if rows:
            yield _pieces(key, rows)

    return join


def _edge_lines(edges: dict[tuple[str, int], tuple[int, int | None]]):
    """Function for mapInArrow: a range's tail of the record before and its open end."""

    def cut(batches: Iterator) -> Iterator:
        seen: dict[tuple[str, int], int] = {}
        tails: dict[tuple[str, int], list[str]] = {}
        ends: dict[tuple[str, int], list[str]] = {}
        for key, lines in _ranges(batches):
            if key not in edges:
                continue
            tail, opened = edges[key]
            low = seen.get(key, 0)
            seen[key] = low + len(lines)
            if low < tail:
                tails.setdefault(key, []).extend(lines.slice(0, tail - low).to_pylist())
            if opened is not None and seen[key] > opened:
                ends.setdefault(key, []).extend(lines.slice(max(0, opened - low)).to_pylist())
        for key, held in tails.items():
            yield _pieces(key, [(0, _TAIL, "\n".join(held))])
        for key, held in ends.items():
            yield _pieces(key, [(edges[key][1], _OPEN, "\n".join(held))])

    return cut


def csv_records(spark: SparkSession, files: list[str], quoted: bool = True) -> DataFrame:
    """(file, start, at, text): the records of the files, headers included.

    start and at order the records of a file. quoted: line breaks may stand in quoted fields.
    A quote that is never closed takes the rest of its file into one record.
    """
    return records_and_heads(spark, files, quoted)[0]


def records_and_heads(
    spark: SparkSession, files: list[str], quoted: bool = True
) -> tuple[DataFrame, dict[str, str | None]]:
    """The records, and the first one of each file as far as the scan for quotes has found it."""
    lines = _lines(spark, files)
    inside, edges, heads = _scanned(lines) if quoted else (set(), {}, {})
    whole = lines.mapInArrow(_join_lines(inside, quoted), _PIECES).drop("kind")
    if edges:
        # An open end and the tails that continue it; two pieces a range at most.
        parts = lines.mapInArrow(_edge_lines(edges), _PIECES)
        order = Window.partitionBy("file").orderBy("start", "at")
        opened = F.sum((F.col("kind") == _OPEN).cast("long")).over(order)
        ordered = F.array_sort(F.collect_list(F.struct("start", "at", "text")))
        grouped = parts.withColumn("record", opened).groupBy("file", "record")
        crossing = grouped.agg(ordered.alias("parts")).select(
            "file",
            F.col("parts")[0]["start"].alias("start"),
            F.col("parts")[0]["at"].alias("at"),
            F.array_join("parts.text", "\n").alias("text"),
        )
        whole = whole.unionByName(crossing)
    heads = {file: head and head.removesuffix("\r") for file, head in heads.items()}
    return whole.withColumn("text", F.regexp_replace("text", r"\r$", "")), heads
