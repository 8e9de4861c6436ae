"""Order-dependent aggregates that combine map-side and give one answer.

Ordering follows the convention that missing keys come last, in both directions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.series import as_col


def order_key(*keys: str | Column) -> Column:
    """Ascending order with missing keys last."""
    parts = []
    for key in keys:
        parts += [as_col(key).isNull(), as_col(key)]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])


def _with_tie_break(column: Column, key: Column) -> Column:
    return F.struct(key.alias("key"), column.alias("value"))


def first_value(column: str | Column, *keys: str | Column) -> Column:
    """Value of the first row in ascending key order; nulls are kept."""
    value = as_col(column)
    return F.min(_with_tie_break(value, order_key(*keys))).getField("value")


def last_value(column: str | Column, *keys: str | Column) -> Column:
    """Value of the last row in ascending key order; nulls are kept."""
    value = as_col(column)
    return F.max(_with_tie_break(value, order_key(*keys))).getField("value")


def first_non_null(column: str | Column, *keys: str | Column) -> Column:
    """First non-null value in ascending key order."""
    value = as_col(column)
    return F.min(
        F.when(value.isNotNull(), _with_tie_break(value, order_key(*keys)))
    ).getField("value")


def value_at_max(column: str | Column, weight: str | Column) -> Column:
    """Value at the largest weight; rows where either is missing do not compete."""
    value, w = as_col(column), as_col(weight)
    return F.max(
        F.when(value.isNotNull() & w.isNotNull(), F.struct(w.alias("w"), value.alias("value")))
    ).getField("value")


def ordered_list(column: str | Column, *keys: str | Column) -> Column:
    """Values as an array in ascending key order (bounded groups only)."""
    entries = F.collect_list(F.struct(order_key(*keys).alias("key"), as_col(column).alias("value")))
    return F.transform(F.array_sort(entries), lambda e: e.getField("value"))


def ordered_text(column: str | Column, separator: str, *keys: str | Column) -> Column:
    """Values joined into one text in ascending key order (bounded groups only)."""
    return F.array_join(ordered_list(column, *keys), separator)
