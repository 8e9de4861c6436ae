"""Window columns over one unit's series (unit keys, integer time).

A series holds one row per period, so its length is bounded by the time span of the
panel, not by the number of input rows. Rows that may repeat within a period go through
``operators.panel.fill_missing`` instead, which summarises each period first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def over_unit(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def by_time(keys: Sequence[str], time: str) -> WindowSpec:
    return over_unit(keys).orderBy(F.col(time).asc_nulls_last())


def _strictly_before(keys: Sequence[str], time: str) -> WindowSpec:
    return by_time(keys, time).rowsBetween(Window.unboundedPreceding, -1)


def _strictly_after(keys: Sequence[str], time: str) -> WindowSpec:
    # A frame that ends at UNBOUNDED FOLLOWING is re-evaluated for every row. Walking the
    # series backwards turns it into a running frame, linear in the series length.
    backwards = over_unit(keys).orderBy(F.col(time).desc_nulls_first())
    return backwards.rowsBetween(Window.unboundedPreceding, -1)


def previous_value(column: str | Column, keys: Sequence[str], time: str) -> Column:
    """Latest non-null value strictly before the row."""
    return F.last(as_col(column), ignorenulls=True).over(_strictly_before(keys, time))


def next_value(column: str | Column, keys: Sequence[str], time: str) -> Column:
    """Earliest non-null value strictly after the row."""
    return F.last(as_col(column), ignorenulls=True).over(_strictly_after(keys, time))


def fill(
    column: str | Column, keys: Sequence[str], time: str, direction: str = "both"
) -> Column:
    """Own value, else the next one ("back"), else the previous one ("forward")."""
    own = as_col(column)
    if direction == "both":
        return F.coalesce(own, next_value(own, keys, time), previous_value(own, keys, time))
    if direction == "back":
        return F.coalesce(own, next_value(own, keys, time))
    if direction == "forward":
        return F.coalesce(own, previous_value(own, keys, time))
    raise ValueError(f"Unknown direction: {direction}")


def log_change(current: Column, base: Column) -> Column:
    """log10 of current over base; null unless both are positive."""
    return F.when((current > 0.0) & (base > 0.0), F.log10(F.try_divide(current, base)))


def magnitude(delta: Column) -> Column:
    """Nearest non-zero power of ten of a log10 change."""
    return F.nullif(F.round(delta), F.lit(0.0))


def shift_magnitude(value: Column, exponent: Column) -> Column:
    """Value divided by ten to the exponent."""
    return F.try_divide(value, F.pow(F.lit(10.0), exponent))


def median(column: Column) -> Column:
    return F.percentile(column, F.lit(0.5))
