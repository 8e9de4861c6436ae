"""Exact duplicates by skew-safe combining.

1. Every task combines its own rows: a buffer of bounded size holds each different text once
   and names it (`rep`); a full buffer is written out and begun anew. Rows keep the name only.
2. Named texts meet by digest and salt, so copies that many tasks have seen meet in several
   tasks, and equal texts of one salt are merged.
3. Winners of digests that more than one salt has seen meet once more, without the salt.

Full contents are compared in all three steps: digests only choose where texts meet, and two
texts under one digest stay two groups. A text moves once, those of step 3 twice; rows follow
their names back (`rep` -> salt winner -> group), so no exchange gathers the rows of a group: the
largest key of each join is what one task has read, or the winners of one text, SALTS at most.

Null counts as the empty text. Rows without an id come before all ids, so another row of their
group stays if there is one; if none has an id, keep_id is null and one row still stays. Of rows
that share id and text one stays. An empty table gives an empty result; further columns are
neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.sources.staging import stage, stage_path

#: Bytes of different texts that a task holds before it writes them out.
BUFFER_BYTES = 32 << 20
#: Places where the copies of one text meet before they meet in one.
SALTS = 64
_ROW_BITS = 40


def as_is(text: Column) -> Column:
    """The comparison text: no change, null is empty."""
    return F.coalesce(text, F.lit(""))


class _Seen:
    """Different texts of one task, each with its name, number of rows and best row."""

    def __init__(self, key_bytes: int):
        self.key_bytes = key_bytes
        self.begin()

    def begin(self) -> None:
        self.by_key: dict[bytes, list[list]] = {}
        self.bytes = 0

    def add(self, text: bytes, doc_id, row: int) -> int:
        sha = hashlib.sha256(text)
        alike = self.by_key.setdefault(sha.digest()[: self.key_bytes], [])
        for entry in alike:
            if entry[0] == text:
                best = entry[3][0]
                entry[2] += 1
                if doc_id is not None and (best is None or doc_id > best):
                    entry[3] = (doc_id, row)
                return entry[1]
        alike.append([text, row, 1, (doc_id, row), sha.hexdigest()])
        self.bytes += len(text) + 200
        return row


def _combine_locally(id_type: T.DataType, key_bytes: int, buffer_bytes: int):
    """Function for mapInArrow: a row for each row (key is null) and each named text."""

    def combine(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_named_schema(id_type))
        kinds = dict(zip(schema.names, schema.types, strict=True))
        row = TaskContext.get().partitionId() << _ROW_BITS
        seen = _Seen(key_bytes)

        def batch(count: int, **columns):
            arrays = [
                pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(count, kinds[c])
                for c in schema.names
            ]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def named():
            entries = [(k, e) for k, alike in seen.by_key.items() for e in alike]
            return batch(
                len(entries),
                doc_id=[e[3][0] for _, e in entries],
                row=[e[3][1] for _, e in entries],
                rep=[e[1] for _, e in entries],
                key=[k for k, _ in entries],
                sha=[e[4] for _, e in entries],
                content=[e[0] for _, e in entries],
                n=[e[2] for _, e in entries],
            )

        for given in batches:
            ids = given.column(0).to_pylist()
            texts = given.column(1).cast(pa.binary()).to_pylist()
            reps = []
            for doc_id, text in zip(ids, texts, strict=True):
                reps.append(seen.add(text, doc_id, row + len(reps)))
                if seen.bytes >= buffer_bytes:
                    yield named()
                    seen.begin()
            if reps:
                yield batch(
                    len(reps), doc_id=ids, row=list(range(row, row + len(reps))), rep=reps
                )
            row += len(reps)
        if seen.by_key:
            yield named()

    return combine


def _named_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("row", T.LongType()),
            T.StructField("rep", T.LongType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("sha", T.StringType()),
            T.StructField("content", T.BinaryType()),
            T.StructField("n", T.LongType()),
        ]
    )


def _merged(rows: DataFrame, keys: list[str], members: str) -> DataFrame:
    """Rows of equal keys and contents as one: the best row, all counts, all members' names."""
    return rows.groupBy(*keys, "content").agg(
        F.max("best").alias("best"),
        F.sum("n").alias("n"),
        F.first("sha").alias("sha"),
        F.min("rep").alias("rep"),
        F.collect_list(members).alias("members"),
    )


def groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = as_is,
    salts: int = SALTS,
    buffer_bytes: int = BUFFER_BYTES,
    key_bytes: int = 32,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of docs.

    Of rows with equal normalised texts, the one with the largest id stays. key_bytes: how much
    of the SHA-256 chooses where texts meet; the result does not depend on it.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), normalise(F.col(text)).alias("text"))
    id_type = given.schema["doc_id"].dataType
    path = stage_path(docs.sparkSession, "named")
    given.mapInArrow(
        _combine_locally(id_type, key_bytes, buffer_bytes), _named_schema(id_type)
    ).write.option("compression", "zstd").parquet(path)
    table = docs.sparkSession.read.parquet(path)

    salted = table.where(F.col("key").isNotNull()).withColumn(
        "salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")
    )
    places = salted.select("key", "salt").distinct()
    places = places.groupBy("key").agg(F.collect_list("salt").alias("salts"))  # `salts` at most
    places = places.select(
        "key", F.explode("salts").alias("salt"), (F.size("salts") == 1).alias("alone")
    )
    texts = salted.select(
        "key", "salt", "rep", "sha", "content", "n", F.struct("doc_id", "row").alias("best")
    )
    winners = stage(
        _merged(texts.join(places, ["key", "salt"]), ["key", "salt", "alone"], "rep").withColumn(
            "content", F.when(~F.col("alone"), F.col("content"))
        ),
        "winners",
    )
    shared = _merged(winners.where(~F.col("alone")), ["key"], "rep").select(
        F.explode("members").alias("rep"), "best", "n", "sha"
    )
    last = (
        winners.where(~F.col("alone")).select("rep", "members").join(shared, "rep").drop("rep")
    ).unionByName(winners.where("alone").select("members", "best", "n", "sha"))
    links = last.select(F.explode("members").alias("rep"), "best", "n", "sha")
    rows = table.where(F.col("key").isNull()).select("doc_id", "row", "rep")
    return rows.join(links, "rep").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = as_is,
) -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that share id and text are one."""
    stay = groups(docs, doc_id, text, normalise).where("kept")
    stay = stay.select(F.col("doc_id").alias("__stay"), F.col("text_sha256").alias("__sha_stay"))
    marked = docs.withColumn("__sha", F.sha2(normalise(F.col(text)).cast("binary"), 256))
    same = F.col(doc_id).eqNullSafe(F.col("__stay")) & (F.col("__sha") == F.col("__sha_stay"))
    return marked.dropDuplicates([doc_id, "__sha"]).join(stay, same, "left_semi").drop("__sha")
