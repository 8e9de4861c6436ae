"""Great-circle distance and the grid cells that make it joinable."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in kilometres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2.0
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _cell_axes(lat: Column, lon: Column, km: float) -> list[Column]:
    """Cube of the unit sphere, as wide as the chord of the distance."""
    width = 2 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2)) * (1 + 1e-9)
    phi, lam = F.radians(lat), F.radians(lon)
    axes = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return [F.floor(axis / width) for axis in axes]


def _cell_key(tag: str, axes: list[Column]) -> Column:
    return F.xxhash64(F.lit(tag), *axes)


def _if_placed(lat: Column, lon: Column, cells: Column) -> Column:
    nowhere = F.array().cast("array<bigint>")
    return F.when(lat.isNotNull() & lon.isNotNull(), cells).otherwise(nowhere)


def own_cell(tag: str, lat: Column, lon: Column, km: float) -> Column:
    """The point's cell as a one-element array; empty where a coordinate is missing."""
    return _if_placed(lat, lon, F.array(_cell_key(tag, _cell_axes(lat, lon, km))))


def near_cells(tag: str, lat: Column, lon: Column, km: float) -> Column:
    """All cells that can hold a point within the distance: the cell and its neighbours."""
    x, y, z = _cell_axes(lat, lon, km)
    cells = [
        _cell_key(tag, [x + i, y + j, z + k])
        for i in (-1, 0, 1)
        for j in (-1, 0, 1)
        for k in (-1, 0, 1)
    ]
    return _if_placed(lat, lon, F.array(*cells))
