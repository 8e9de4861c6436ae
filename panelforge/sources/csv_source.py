"""Typed CSV source: text in, declared columns out, with a Parquet copy beside the file."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.constants import DATE_FORMAT
from panelforge.sources.csv_records import records_and_heads

_FINGERPRINT = "panelforge.schema"


def parse_short_date(
    text: Column, as_of: str | None = None, date_format: str = DATE_FORMAT
) -> Column:
    """Two-digit-year timestamp; a date after ``as_of`` belongs to the century before.

    The text is a local time without zone: it is read as UTC and rebuilt from the epoch, so
    the session's time zone and its clock changes do not matter.
    """
    instant = F.try_to_timestamp(F.concat(text, F.lit(" UTC")), F.lit(f"{date_format} VV"))
    seconds = F.make_dt_interval(secs=F.unix_seconds(instant).cast("decimal(18,6)"))
    parsed = F.lit("1970-01-01").cast("timestamp_ntz") + seconds
    limit = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    century = F.make_ym_interval(F.lit(100), F.lit(0))
    return F.when(parsed > limit.cast("timestamp_ntz"), parsed - century).otherwise(parsed)


def cast_text(
    name: str,
    dtype: T.DataType,
    na_values: Sequence[str] | None = None,
    as_of: str | None = None,
    date_format: str = DATE_FORMAT,
    errors: str = "coerce",
) -> Column:
    """Text column to its declared type; listed texts and (by default) bad values are null."""
    text = F.col(f"`{name}`")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        value = parse_short_date(text, as_of, date_format)
    elif isinstance(dtype, T.IntegralType):
        # Fractions round half away from zero rather than fail.
        value = F.round(text.try_cast("double")).try_cast(dtype)
    elif isinstance(dtype, T.StringType):
        value = text
    else:
        value = text.try_cast(dtype)
    if errors == "raise":
        bad = text.isNotNull() & value.isNull()
        value = F.when(
            bad, F.raise_error(F.concat(F.lit(f"bad value in {name}: "), text)).cast(dtype)
        ).otherwise(value)
    if na_values is not None:
        value = F.when(~F.coalesce(text.isin(*na_values), F.lit(False)), value)
    return value.alias(name)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(path, bytes, time) of the source's files, by listing only."""
    listed = (
        spark.read.format("binaryFile")
        .load(path)
        .select("path", "length", F.col("modificationTime").cast("string"))
    )
    return sorted(map(tuple, listed.collect()))


def _fingerprint(
    schema: T.StructType,
    na_values: Sequence[str] | None,
    conventions: str,
    files: list[tuple[str, int, str]],
) -> str:
    content = json.dumps([schema.json(), list(na_values or []), conventions, files])
    return hashlib.sha256(content.encode()).hexdigest()


def _column_names(header: str) -> tuple[str, ...]:
    """Names of a header record; blank and repeated ones are told apart by their place."""
    names = next(csv.reader(io.StringIO(header, newline="")))
    lower = [n.lower() for n in names]
    return tuple(
        f"_c{k}" if not n else f"{n}{k}" if lower.count(n.lower()) > 1 else n
        for k, n in enumerate(names)
    )


def _read_text(spark: SparkSession, files: list[str], multi_line: bool) -> list[DataFrame]:
    """The files as text columns, one table per header; columns go by name in every file.

    All headers come from the scan for quotes, or from one job where that has not found them, and
    large files are read by many tasks.
    """
    records, heads = records_and_heads(spark, files, multi_line)
    first = (F.col("start") == 0) & (F.col("at") == 0)
    if not heads or None in heads.values():
        heads = {r.file: r.text for r in records.where(first).select("file", "text").collect()}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, head in heads.items():
        by_header.setdefault(_column_names(head), []).append(file)
    tables = []
    for header, members in sorted(by_header.items()):
        named = records.where(~first & (F.col("text") != ""))
        if len(by_header) > 1:
            listed = spark.createDataFrame([(m,) for m in members], "file string")
            named = named.join(listed, "file", "left_semi")
        ddl = ", ".join(f"`{name.replace('`', '``')}` string" for name in header)
        parsed = F.from_csv("text", ddl, {"escape": '"', "multiLine": "true"})
        tables.append(named.select(parsed.alias("r")).select("r.*"))
    return tables


def read_typed_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    na_values: Sequence[str] | None = None,
    as_of: str | None = None,
    date_format: str = DATE_FORMAT,
    errors: str = "coerce",
    reload: bool = False,
    cache: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Read the declared columns of a CSV file (or folder of CSV files).

    Files of a folder may order their columns differently; a declared column that a file
    lacks is an error. The first read writes a Parquet copy; later reads scan that copy, with
    pruning and pushdown. A copy is rebuilt if it is incomplete, was made under other column
    types or conventions, or if a file of the source was added, removed or changed since.

    With multi_line a quoted field may hold line breaks. Large files are split either way.
    """
    if not path.endswith(".csv"):
        raise ValueError(f"Only CSV sources are supported: {path}")
    cache = cache or path.removesuffix(".csv") + ".parquet"
    files = _files(spark, path)
    conventions = f"{date_format}|{as_of}|{errors}|{multi_line}"
    mark = _fingerprint(schema, na_values, conventions, files)
    if not reload:
        cached = _read_cache(spark, cache, mark)
        if cached is not None:
            return cached
    names = [name for name, size, _ in files if size]
    parts = [
        raw.select(
            *[cast_text(f.name, f.dataType, na_values, as_of, date_format, errors) for f in schema]
        )
        for raw in _read_text(spark, names, multi_line)
    ]
    typed = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    first = schema[0].name
    marked = typed.withMetadata(first, {_FINGERPRINT: mark})
    marked.write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def _read_cache(spark: SparkSession, cache: str, mark: str) -> DataFrame | None:
    try:
        spark.read.text(f"{cache}/_SUCCESS")  # absent if the write broke off
        cached = spark.read.parquet(cache)
    except AnalysisException:
        return None
    if cached.schema[0].metadata.get(_FINGERPRINT) != mark:
        return None
    return cached
