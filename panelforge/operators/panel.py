"""Panel shape: balancing, filling, interpolation, dense vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.ordered import ordered_list
from panelforge.functions.series import (
    by_time,
    fill,
    next_value,
    previous_value,
)
from panelforge.operators.joins import null_safe_join


def balance(
    df: DataFrame,
    time: str,
    keys: Sequence[str],
    universe: DataFrame | None = None,
) -> DataFrame:
    """Every unit gets a row for every period of the whole panel.

    Rows of ``df`` pass through where they are: each already sits in exactly one cell of
    the grid, so only the absent cells are generated. Units are shuffled as the set of
    periods they have (at most one entry per period), never as rows, so a unit with very
    many rows costs no more than any other. Rows without a time are left out.

    ``universe`` may name a cheaper table with the same units and periods, such as the
    raw table an aggregated panel was made from.
    """
    keys = list(keys)
    source = df if universe is None else universe
    rest = [c for c in df.columns if c not in (*keys, time)]
    period = F.col(time).cast("long")
    span = source.agg(F.min(period).alias("lo"), F.max(period).alias("hi"))
    grid = F.sequence(span.select("lo").scalar(), span.select("hi").scalar())
    present = source.groupBy(*keys).agg(F.collect_set(period).alias("_present"))
    absent = present.select(
        *keys,
        F.explode(F.array_except(grid, F.col("_present"))).alias(time),
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest],
    )
    rows = df.where(F.col(time).isNotNull()).select(*keys, period.alias(time), *rest)
    return rows.unionByName(absent)


def fill_series(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], time: str, direction: str = "both"
) -> DataFrame:
    """Fill columns of a panel with one row per unit and period."""
    return df.withColumns({c: fill(c, keys, time, direction) for c in columns})


def fill_missing(
    df: DataFrame,
    columns: Mapping[str, Column],
    keys: Sequence[str],
    time: str,
    direction: str = "both",
) -> DataFrame:
    """Fill columns of a table that may hold many rows per unit and period.

    Within a period missing values sort first, then ascending. Each period is summarised
    (map-side) to its smallest and largest value, the fill runs over the summaries and is
    joined back, so no task ever sorts all rows of a unit.
    """
    if direction not in ("both", "back", "forward"):
        raise ValueError(f"Unknown direction: {direction}")
    keys = list(keys)
    summary = df.groupBy(*keys, time).agg(
        *[F.min(expr).alias(f"_low_{c}") for c, expr in columns.items()],
        *[F.max(expr).alias(f"_high_{c}") for c, expr in columns.items()],
    )
    donors = {}
    for c in columns:
        donor = []
        if direction in ("both", "back"):
            donor += [F.col(f"_low_{c}"), next_value(f"_low_{c}", keys, time)]
        if direction in ("both", "forward"):
            donor += [previous_value(f"_high_{c}", keys, time)]
        donors[f"_donor_{c}"] = F.coalesce(*donor)
    donated = summary.select(*keys, time, *[v.alias(k) for k, v in donors.items()])
    joined = null_safe_join(df, donated, [*keys, time], "left")
    filled = {c: F.coalesce(expr, F.col(f"_donor_{c}")) for c, expr in columns.items()}
    return joined.select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns],
        *[filled[c].alias(c) for c in filled if c not in df.columns],
    )


def fill_from_latest(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], time: str
) -> DataFrame:
    """Fill a missing value from the unit's latest non-missing one, if not older than the row.

    One partial aggregate per unit and a join; the largest value wins within a year.
    """
    latest = df.groupBy(*keys).agg(
        *[
            F.max(
                F.when(
                    F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).alias("v"))
                )
            ).alias(f"_latest_{c}")
            for c in columns
        ]
    )
    joined = null_safe_join(df, latest, keys, "left")

    def filled(c: str) -> Column:
        donor = F.col(f"_latest_{c}")
        reachable = F.col(time).isNull() | (donor.getField("t") >= F.col(time))
        return F.coalesce(F.col(c), F.when(reachable, donor.getField("v"))).alias(c)

    return joined.select(*[filled(c) if c in columns else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, column: str, keys: Sequence[str], time: str) -> DataFrame:
    """Straight line between the nearest known values; nothing beyond the edges."""
    known_time = F.when(F.col(column).isNotNull(), F.col(time))
    bounds = df.withColumns(
        {
            "_v0": previous_value(column, keys, time),
            "_t0": previous_value(known_time, keys, time),
            "_v1": next_value(column, keys, time),
            "_t1": next_value(known_time, keys, time),
        }
    )
    share = F.try_divide(
        (F.col(time) - F.col("_t0")).cast("double"), (F.col("_t1") - F.col("_t0")).cast("double")
    )
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share
    return bounds.withColumn(column, F.coalesce(F.col(column), line)).drop(
        "_v0", "_t0", "_v1", "_t1"
    )


def dense_vectors(
    df: DataFrame,
    unit: str,
    time: str,
    codes: Sequence[str],
    value: str,
    span: tuple[int, int],
    combos: Sequence[tuple],
    vector: str = "releases",
    total: str = "total_releases",
) -> DataFrame:
    """One fixed-length vector per unit: periods x code combinations, absent cells zero.

    The input is reduced to the wanted cells first (largest value per cell), so a unit
    contributes at most ``periods * len(combos)`` entries before it is assembled.
    """
    lo, hi = span
    combos = sorted(combos)
    wanted = F.coalesce(
        *[
            F.when(_matches(codes, combo), F.lit(i))
            for i, combo in enumerate(combos)
        ]
    )
    cell = (F.col(time) - F.lit(lo)) * F.lit(len(combos)) + F.col("_combo")
    length = (hi - lo + 1) * len(combos)
    in_span = F.col(time).between(lo, hi) & wanted.isNotNull()
    # Units without any wanted cell still get an all-zero vector.
    cells = (
        df.where(F.col(unit).isNotNull())
        .withColumn("_combo", F.when(in_span, wanted))
        .groupBy(unit, F.when(in_span, F.col(time)).alias(time), "_combo")
        .agg(F.max(F.when(in_span, F.col(value))).alias("_value"))
    )
    entries = F.map_from_entries(
        F.collect_list(
            F.when(
                F.col("_combo").isNotNull(),
                F.struct(cell.cast("int"), F.coalesce("_value", F.lit(0.0)).cast("double")),
            )
        )
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("_entries"), i), F.lit(0.0)),
    )
    return (
        cells.groupBy(unit)
        .agg(entries.alias("_entries"))
        .select(unit, dense.alias(vector))
        .withColumn(total, F.aggregate(vector, F.lit(0.0), lambda a, x: a + x))
    )


def _matches(codes: Sequence[str], combo: tuple) -> Column:
    condition = F.lit(True)
    for name, wanted in zip(codes, combo, strict=True):
        condition = condition & (F.col(name) == F.lit(wanted))
    return condition


def trim_to_active_span(
    df: DataFrame, value: str, keys: Sequence[str], time: str
) -> DataFrame:
    """Keep a unit's periods between its first and last non-missing value."""
    active = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    )
    return (
        null_safe_join(df, active, keys, "inner")
        .where(F.col(time).between(F.col("_first"), F.col("_last")))
        .drop("_first", "_last")
    )


def pivot_wide(
    df: DataFrame, index: Sequence[str], name: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Codes to columns, largest value per cell; the code list is stated, never collected."""
    return df.groupBy(*index).agg(
        *[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    )


__all__ = [
    "balance",
    "by_time",
    "dense_vectors",
    "fill_from_latest",
    "fill_missing",
    "fill_series",
    "interpolate",
    "ordered_list",
    "pivot_wide",
    "trim_to_active_span",
]
