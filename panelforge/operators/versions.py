"""Stacking of dataset versions and collapse to the latest value."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.constants import DATASET_VERSIONS
from panelforge.functions.ordered import order_key

Loader = Callable[[SparkSession, str], DataFrame]


def stack(
    spark: SparkSession, loader: Loader, versions: Iterable[str] = tuple(DATASET_VERSIONS)
) -> DataFrame:
    """One scan per version, tagged with the version and its place in publication order."""
    frames = [
        loader(spark, version).withColumns(
            {"version": F.lit(version), "version_ordinal": F.lit(ordinal)}
        )
        for ordinal, version in enumerate(versions)
    ]
    return reduce(DataFrame.unionByName, frames)


def add_metadata(
    stacked: DataFrame, metadata: DataFrame, file_id: str = "fileId_EUReg"
) -> DataFrame:
    """Submission date and reporting year of the file each row came from."""
    submissions = metadata.select(
        "version", F.col("fileId").alias(file_id), "dateSubmitted", "reportingYear"
    )
    return stacked.join(submissions, [file_id, "version"], "left")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], drop: Sequence[str] = ()
) -> DataFrame:
    """The last row per key in the given order, missing order values counting as last.

    A single map-side combined maximum over (order, row) rather than one aggregate per
    column; equal order values are settled by the row itself, so reruns agree.
    """
    rest = [c for c in df.columns if c not in (*keys, *order, *drop)]
    row = F.struct(order_key(*order).alias("order"), *[F.col(c) for c in rest])
    latest = df.groupBy(*keys).agg(F.max(row).alias("_latest"))
    return latest.select(*keys, *[F.col("_latest").getField(c).alias(c) for c in rest])


def stack_versions(
    spark: SparkSession,
    loader: Loader,
    metadata_loader: Loader,
    keys: Sequence[str],
    versions: Iterable[str] = tuple(DATASET_VERSIONS),
    file_id: str = "fileId_EUReg",
) -> DataFrame:
    """Stack all versions and keep the latest row per key."""
    versions = list(versions)
    stacked = add_metadata(
        stack(spark, loader, versions), stack(spark, metadata_loader, versions), file_id
    )
    order = [
        c
        for c in ("reportingYear", "dateSubmitted", "version_ordinal", file_id)
        if c not in keys
    ]
    return latest_per_key(stacked, keys, order, drop=["version"])
