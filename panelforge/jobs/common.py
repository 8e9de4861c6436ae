"""What the linkage jobs share."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelforge.linkage import levels as lv
from panelforge.linkage.blocking import Rule
from panelforge.linkage.model import Model, fit
from panelforge.linkage.score import predict
from panelforge.sources.catalog import Catalog
from panelforge.sources.staging import stage


@dataclass(frozen=True)
class LinkageSpec:
    """Settings of one linkage job."""

    comparisons: tuple[lv.Comparison, ...]
    rules: tuple[Rule, ...]
    prior_rules: tuple[tuple[str, ...], ...]
    recall: float
    training_rules: tuple[Rule, ...]
    threshold: float
    unique_id: str = "unique_id"
    max_pairs: float = 1e8
    seed: int = 123
    directed: bool = False


def link(
    left: DataFrame, right: DataFrame | None, spec: LinkageSpec
) -> tuple[Model, DataFrame]:
    """Train on the staged records, then score all pairs at or above the threshold."""
    left = stage(left, "records_left")
    right = None if right is None else stage(right, "records_right")
    model = fit(
        spec.comparisons,
        left,
        right,
        spec.unique_id,
        spec.prior_rules,
        spec.recall,
        spec.training_rules,
        spec.max_pairs,
        spec.seed,
    )
    pairs = predict(
        left, right, spec.unique_id, spec.rules, model, spec.threshold, spec.directed
    )
    return model, pairs


def location(
    exact_levels: Sequence[lv.Level], distances: Sequence[float], *fallback: lv.Level
) -> lv.Comparison:
    """Address or distance; missing only if coordinates and postal code both are."""
    missing = lv.all_of(
        lv.null_level("pointGeometryLat", "pointGeometryLon"), lv.null_level("postalCode")
    )
    rings = [lv.within_km("pointGeometryLat", "pointGeometryLon", km) for km in distances]
    return lv.compare(
        "location",
        missing,
        lv.any_of(*exact_levels) if len(exact_levels) > 1 else exact_levels[0],
        *rings,
        *fallback,
        lv.otherwise(),
    )


def near(km: float) -> lv.Level:
    return lv.within_km("pointGeometryLat", "pointGeometryLon", km)


def main(run: Callable[[Catalog, str], None], name: str) -> None:
    """Command line: catalogue root and output folder."""
    parser = argparse.ArgumentParser(prog=name)
    parser.add_argument("root", help="folder of the catalogue")
    parser.add_argument("output", help="folder for the crosswalk")
    parser.add_argument("--as-of", default=None, help="date that settles two-digit years")
    args = parser.parse_args()
    spark = SparkSession.builder.appName(name).getOrCreate()
    run(Catalog(spark, args.root, args.as_of), args.output)
