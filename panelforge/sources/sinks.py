"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ordered_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """CSV with header, ordered across part files (range partitioned, then sorted)."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    df.orderBy(*keys).write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
