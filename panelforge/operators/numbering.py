"""Dense global numbers without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.series import as_col
from panelforge.sources.staging import stage

#: Bits of Spark's running number that count rows inside a partition.
_INSIDE = 33


def with_dense_ids(
    df: DataFrame, order: Sequence[str | Column], name: str, first: int = 1
) -> DataFrame:
    """df with the place of each row in the order, counted from ``first`` without gaps.

    Rows are range partitioned and sorted once and stored with their place inside the partition;
    what the partitions before hold is a sum over one row per partition. The order should end in a
    unique column: equal rows are numbered in any order, and cannot be split over partitions.
    Missing values come first.
    """
    keys = [as_col(c) for c in order]
    placed = stage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
        "places",
    )
    part = F.shiftright("_place", _INSIDE)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << _INSIDE) - 1))
    return (
        placed.withColumn("_part", part)
        .join(stage(offsets, "offsets"), "_part")
        .withColumn(name, F.col("_offset") + inside + first)
        .select(*df.columns, name)
    )
