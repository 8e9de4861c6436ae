"""Flattening of the site - facility - installation - part hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.constants import Level
from panelforge.operators.crosswalk import apply_crosswalk
from panelforge.operators.joins import union_distinct_by_name


def flatten(
    levels: Sequence[tuple[str, DataFrame]],
    key_of: Mapping[str, str],
    name_column: str | None = "nameOfFeature",
) -> DataFrame:
    """Left join every level to the one above on the parent key.

    ``levels`` lists (level, table) top down; each table below the top has its own key and
    ``Parent_<key of the level above>``. Names get the level as suffix below the top.
    """
    (top, result), *lower = levels
    names = [name_column] if name_column else []
    result = result.select(key_of[top], *names)
    above = top
    for level, table in lower:
        parent = key_of[above]
        columns = [F.col(key_of[level]), F.col(f"Parent_{parent}").alias(parent)]
        columns += [F.col(n).alias(f"{n}_{level}") for n in names]
        result = result.join(table.select(*columns), parent, "left")
        above = level
    return result


def identifiers(
    site: DataFrame,
    facility: DataFrame,
    installation: DataFrame,
    part: DataFrame,
    plant_clusters: DataFrame | None = None,
    plant_links: DataFrame | None = None,
    include_name: bool = True,
    case_sensitive: bool = True,
) -> DataFrame:
    """All identifiers of the four levels in one table.

    ``plant_clusters`` rewires facilities of plants that had none; ``plant_links`` appends
    older plants as parts of the facility they were linked to.
    """
    tables = dict(zip(Level, (site, facility, installation, part), strict=True))
    data = flatten(
        [(level.name, table) for level, table in tables.items()],
        {level.name: level.key for level in Level},
        "nameOfFeature" if include_name else None,
    )
    if plant_clusters is not None:
        data = apply_crosswalk(data, plant_clusters, Level.Facility.key)
    if plant_links is not None:
        plants = plant_links.select(
            F.col("Unique_Plant_ID").alias(Level.Installation_Part.key), Level.Facility.key
        )
        data = union_distinct_by_name(data, plants)
    if not case_sensitive:
        data = data.select(*[F.lower(c).alias(c) for c in data.columns])
    return data
