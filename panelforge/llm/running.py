"""Running totals and ranks over tables of any size, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block; a block is summed by one task, block totals are summed in a second step.
BLOCK_ROWS = 20_000


def running_total(
    rows: DataFrame,
    value: str,
    key: str,
    count: int,
    name: str,
    per: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """rows with the sum of `value` over all rows before, in a fixed order, within `per`.

    Rows are dealt to blocks by a hash of the unique key, so that even a single value of `per`
    spreads over all blocks. rows must be a stored table (it is read twice).
    """
    blocks = max(1, -(-count // block_rows))
    group = [per] if per else []
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    totals = dealt.groupBy(*group, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = totals.select(
        *group, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base")
    )
    inside = (
        Window.partitionBy(*group, "__block")
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        dealt.withColumn("__own", own)
        .join(base, [*group, "__block"])
        .withColumn(name, F.col("__base") + F.col("__own"))
        .drop("__block", "__own", "__base")
    )
