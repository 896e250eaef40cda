"""Distances and containment as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return C.EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def manhattan_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Along the street grid."""
    return F.abs(lat1 - lat2) * C.METERS_PER_DEGREE + F.abs(lon1 - lon2) * C.METERS_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))


def flat_manhattan_m() -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """manhattan_m over arrays, as a function that goes to tasks without this package."""
    wide = C.METERS_PER_DEGREE
    return lambda lat1, lon1, lat2, lon2: np.abs(lat1 - lat2) * wide + np.abs(lon1 - lon2) * wide * np.cos(np.radians((lat1 + lat2) / 2))


def to_millimeters(meters: Column) -> Column:
    """A distance to three digits, halves up, by its thousandfold as SQL's round takes it; without a decimal for each row."""
    return F.floor(meters * 1000.0 + math.nextafter(0.5, 0.0)) / 1000.0


def cell(x: Column, degrees: float = C.CELL_DEGREES) -> Column:
    return F.floor(x / F.lit(degrees))


def in_box(lat: Column, lon: Column, box: dict[str, float]) -> Column:
    return lat.between(box["min_lat"], box["max_lat"]) & lon.between(box["min_lon"], box["max_lon"])


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting over a ring: an array of structs (lat, lon), not closed."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.lat.alias("y1"), a.lon.alias("x1"), b.lat.alias("y2"), b.lon.alias("x2")))
    crossed = F.filter(edges, lambda e: ((e.y1 > lat) != (e.y2 > lat)) & (lon < (e.x2 - e.x1) * (lat - e.y1) / F.nullif(e.y2 - e.y1, F.lit(0.0)) + e.x1))
    return F.size(crossed) % 2 == 1


def ring_sqkm(ring: str, lat: Column) -> Column:
    """Shoelace area, in square kilometres at a latitude."""
    n = F.size(ring)
    cross = F.zip_with(F.col(ring), F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1)), lambda a, b: a.lon * b.lat - b.lon * a.lat)
    total = F.aggregate(cross, F.lit(0.0), lambda acc, x: acc + x)
    return F.abs(total) / 2 * (C.METERS_PER_DEGREE / 1000) ** 2 * F.cos(F.radians(lat))
