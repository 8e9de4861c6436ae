"""Packing documents into token sequences of equal length by cutting-stock patterns.

1. Documents are tokenised once into a stored table. Whole sequences inside a long document
   are taken as they are; what is left of it (its rest) is to be packed.
2. The histogram of rest lengths (in classes of `UNIT` tokens, so of bounded size) is the
   demand of a linear program; column generation gives patterns of classes.
3. Rests are ranked within their class and take the places of the rounded patterns.
4. Rests without a place, and those of the last few sequences, form one stream that is cut
   to fill the gaps exactly; what the stream has over becomes sequences of its own, the last
   of them cut at powers of two. So nothing is padded.

Null and blank texts are the end token alone. Rows are told apart by a number of their own, so
repeated ids and texts are packed like others. An empty table gives an empty result. The
result has the columns named in `RESULT` only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.cutting_stock import Pattern, patterns
from panelforge.llm.running import running_total
from panelforge.llm.workers import release
from panelforge.sources.staging import stage, stage_path

LENGTH = 4096
UNIT = 32
END_ID = 2
#: Words whose ids a worker remembers.
CACHE_WORDS = 600_000
RESULT = (
    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
)


class Encoder:
    """Ids of texts, word by word: blanks and line feeds always end a token here.

    That holds for tokenizers that drop white space and split symbols from letters; others need
    by_word=False. The ids of a word are remembered, so most words of a text are looked up.
    Words are told apart by less than their spelling: A-Z are lower-cased if the tokenizer does
    so itself, and symbols behind a letter or digit are words of their own.
    """

    #: Symbols behind a small Latin letter or digit, without the apostrophe of contractions.
    _symbols = re.compile(r"(?<=[a-z0-9\u00df-\u00f6\u00f8-\u00ff])([!-&(-/:-@\[-`{-~]+)(?=[ \n]|$)")

    def __init__(self, path: str, by_word: bool = True) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        self.known: dict[str, bytes] = {"": b""}
        self.lower = self._raw(["AZ"])[0] == self._raw(["az"])[0]
        # a sign that is one token and stands between words that are encoded together
        marks = ((m, np.frombuffer(self._raw([m])[0], "<u4")) for m in "~^`{")
        self.mark, self.mark_id = next(((m, i[0]) for m, i in marks if len(i) == 1), (None, 0))

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words are encoded a thousand at a time."""
        found: list[bytes] = []
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            if self.mark is not None and not any(self.mark in w for w in part):
                data = self._raw([f" {self.mark} ".join(part)])[0]
                ends = np.flatnonzero(np.frombuffer(data, dtype="<u4") == self.mark_id)
                if len(ends) == len(part) - 1:
                    ends = [4 * e for e in ends.tolist()]
                    begins = [0, *(e + 4 for e in ends)]
                    found.extend(map(data.__getitem__, map(slice, begins, [*ends, len(data)])))
                    continue
            found.extend(self._raw(part))
        return found

    def _parts(self, text: str) -> list[str]:
        if "<|" not in text:  # else it may hold special tokens, which are not to be changed
            if self.lower:
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            text = self._symbols.sub(r" \1", text)
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return self._raw(texts)
        parts = [self._parts(t) for t in texts]
        new = set().union(*parts).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known = {"": b""}
                new = set().union(*parts) - {""}
            words = list(new)
            self.known.update(zip(words, self._words(words), strict=True))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


@lru_cache(maxsize=2)
def _encoder(path: str, by_word: bool) -> Encoder:
    return Encoder(path, by_word)


def _tokenise(
    docs: DataFrame, doc_id: str, text: str, path: str, end_id: int, length: int, by_word: bool
) -> DataFrame:
    """Stored rows: row, doc_id, doc_tokens, rest, rest_crc, crcs (of whole sequences), ids."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, by_word)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                data = [ids + end for ids in encoder.encode(part.column("text").to_pylist())]
                whole = [len(d) // (4 * length) for d in data]
                rest = [d[4 * length * w :] for d, w in zip(data, whole, strict=True)]
                crcs = [
                    [zlib.crc32(d[4 * length * i : 4 * length * (i + 1)]) for i in range(w)]
                    for d, w in zip(data, whole, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        pa.array([len(d) // 4 for d in data], pa.int64()),
                        pa.array([len(r) // 4 for r in rest], pa.int64()),
                        pa.array([zlib.crc32(r) for r in rest], pa.int64()),
                        pa.array(crcs, pa.list_(pa.int64())),
                        pa.array(rest, pa.binary()),
                    ],
                    names=["row", "doc_id", "doc_tokens", "rest", "rest_crc", "crcs", "ids"],
                )
        release()

    made = rows.mapInArrow(
        encode,
        "row long, doc_id long, doc_tokens long, rest long, rest_crc long, "
        "crcs array<long>, ids binary",
    )
    spark = docs.sparkSession
    target = stage_path(spark, "tokens")
    made.write.option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def _slots(found: list[Pattern]) -> tuple[list[tuple], int]:
    """(class, first rank, end rank, first sequence, pieces per sequence), and the sequences."""
    rows, taken, first = [], {}, 0
    for pattern in found:
        for width, pieces in sorted(pattern.counts.items()):
            low = taken.get(width, 0)
            high = low + pieces * pattern.times
            rows.append((width, low, high, first, pieces))
            taken[width] = high
        first += pattern.times
    return rows, first


def _piece_crc(ids: Column, start: Column, length: Column) -> Column:
    @F.pandas_udf("long")
    def made(data: pd.Series, begin: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(
            [zlib.crc32(d[4 * b : 4 * (b + n)]) for d, b, n in zip(data, begin, size, strict=True)],
            dtype="int64",
        )

    return made(ids, start, length)


def _overlaps(stream: DataFrame, targets: DataFrame, width: int, total: int) -> DataFrame:
    """(row, target, at, size): the common part of each stream item and target.

    Both tile the same line from 0 to total; both are clipped to cells of a fixed width, so a
    window never holds more than a cell's starts.
    """

    def clipped(rows: DataFrame, begin: str, size: str, ident: str) -> DataFrame:
        last = F.floor((F.col(begin) + F.col(size) - 1) / width)
        cells = F.sequence(F.floor(F.col(begin) / width), last)
        return rows.select(F.col(ident), F.col(begin), F.explode(cells).alias("cell")).select(
            ident, "cell", F.greatest(F.col(begin), F.col("cell") * width).alias("at")
        )

    starts = clipped(stream, "before", "rest", "row").unionByName(
        clipped(targets, "t_before", "t_size", "target"), allowMissingColumns=True
    )
    merged = starts.groupBy("cell", "at").agg(F.max("row").alias("row"), F.max("target").alias("target"))
    order = Window.partitionBy("cell").orderBy("at")
    end = F.coalesce(
        F.lead("at").over(order), F.least((F.col("cell") + 1) * width, F.lit(total))
    )
    return (
        merged.select(
            "at",
            (end - F.col("at")).alias("size"),
            F.last("row", ignorenulls=True).over(order).alias("row"),
            F.last("target", ignorenulls=True).over(order).alias("target"),
        )
        .groupBy("row", "target")
        .agg(F.min("at").alias("at"), F.sum("size").alias("size"))
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    length: int = LENGTH,
    unit: int = UNIT,
    by_word: bool = True,
) -> DataFrame:
    """One row per piece: the columns of RESULT."""
    spark = docs.sparkSession
    tokens = _tokenise(docs, doc_id, text, tokenizer_path, end_id, length, by_word)
    items = tokens.drop("ids", "crcs").where("rest > 0").withColumn(
        "class", F.ceil(F.col("rest") / unit).cast("int")
    )
    # at most length / unit rows
    demand = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count("*").alias("n")).collect()}
    slots, planned = _slots(patterns(demand, length // unit))
    ranked = running_total(
        items.withColumn("one", F.lit(1)), "one", "row", sum(demand.values()), "rank", per="class"
    ).drop("one")
    # at most (length / unit) ** 2 rows of five numbers
    places = spark.createDataFrame(
        slots, "class int, low long, high long, first long, pieces long"
    )
    inside = (
        (ranked["class"] == places["class"])
        & (ranked["rank"] >= places["low"])
        & (ranked["rank"] < places["high"])
    )
    placed = stage(
        ranked.join(F.broadcast(places), inside, "left")
        .withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("pieces")))
        .select("row", "doc_id", "doc_tokens", "rest", "rest_crc", ranked["class"], "sequence_id"),
        "placed",
    )
    sums = placed.agg(
        F.sum(F.when(F.col("sequence_id").isNull(), F.col("rest"))).alias("loose"),
        F.sum(F.when(F.col("sequence_id").isNotNull(), F.col("rest"))).alias("held"),
    ).first()
    loose, gap = sums["loose"] or 0, planned * length - (sums["held"] or 0)
    live = planned - min(planned, max(0, -(-(gap - loose) // length)))

    # whole rests
    whole = placed.where(F.col("sequence_id") < live)
    behind = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("class"), "row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    uncut = whole.select(
        "doc_id",
        (F.col("doc_tokens") - F.col("rest")).alias("start"),
        F.col("rest").alias("length"),
        F.col("rest_crc").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("rest").over(behind), F.lit(0)).alias("offset"),
    )

    # the stream that fills the gaps
    loose_rows = stage(
        placed.where(F.col("sequence_id").isNull() | (F.col("sequence_id") >= live)).select(
            "row", "rest"
        ),
        "loose",
    )
    sizes = loose_rows.agg(F.count("*").alias("n"), F.sum("rest").alias("s")).first()
    total = sizes["s"] or 0
    stream = running_total(loose_rows, "rest", "row", sizes["n"], "before")
    gaps = stage(
        whole.groupBy("sequence_id")
        .agg(F.sum("rest").alias("filled"))
        .where(F.col("filled") < length)
        .select("sequence_id", "filled", (length - F.col("filled")).alias("t_size")),
        "gaps",
    )
    open_gaps = gaps.agg(F.count("*").alias("n"), F.sum("t_size").alias("s")).first()
    in_gaps = open_gaps["s"] or 0
    filled = running_total(gaps, "t_size", "sequence_id", open_gaps["n"], "t_before").select(
        F.col("sequence_id").alias("target"), "t_before", "t_size", F.col("filled").alias("t_offset")
    )
    over = total - in_gaps
    fresh = spark.range(over // length).select(
        (live + F.col("id")).alias("target"),
        (in_gaps + F.col("id") * length).alias("t_before"),
        F.lit(length).cast("long").alias("t_size"),
        F.lit(0).cast("long").alias("t_offset"),
    )
    tail, at, target = [], in_gaps + over // length * length, live + over // length
    for bit in reversed(range(length.bit_length())):
        if over % length >> bit & 1:
            tail.append((target, at, 1 << bit, 0))
            at, target = at + (1 << bit), target + 1
    ends = spark.createDataFrame(tail, "target long, t_before long, t_size long, t_offset long")
    targets = filled.unionByName(fresh).unionByName(ends)
    cuts = stage(
        _overlaps(stream, targets, 16 * length, total)
        .join(targets, "target")
        .join(stream.select("row", "before"), "row")
        .select(
            "row",
            (F.col("at") - F.col("before")).alias("begin"),
            F.col("size").alias("length"),
            F.col("target").alias("sequence_id"),
            (F.col("t_offset") + F.col("at") - F.col("t_before")).alias("offset"),
        ),
        "cuts",
    )
    # ids of the few rows that are cut; their number alone decides how they are looked up
    loose_ids = stage(
        tokens.select("row", "doc_id", "doc_tokens", "rest", "ids").join(
            loose_rows.select("row"), "row", "left_semi"
        ),
        "loose-ids",
    )
    cut = cuts.join(loose_ids, "row").select(
        "doc_id",
        (F.col("doc_tokens") - F.col("rest") + F.col("begin")).alias("start"),
        "length",
        _piece_crc(F.col("ids"), F.col("begin"), F.col("length")).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )

    # whole sequences inside long documents
    long_docs = stage(
        tokens.where(F.size("crcs") > 0).select(
            "row", "doc_id", "doc_tokens", "crcs", F.size("crcs").cast("long").alias("n")
        ),
        "long",
    )
    numbered = running_total(long_docs, "n", "row", long_docs.count(), "first")
    full = numbered.select(
        "doc_id", "doc_tokens", "first", F.posexplode("crcs").alias("i", "ids_crc32")
    ).select(
        "doc_id",
        (F.col("i") * length).cast("long").alias("start"),
        F.lit(length).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (target + F.col("first") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return uncut.unionByName(cut).unionByName(full).select(*RESULT)
