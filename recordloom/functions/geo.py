"""Distance and location-tree relations (FT3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def zone(lost: Column, found: Column, nearest: bool = False) -> Column:
    """How two nodes of a location tree relate; null where nothing is shared.

    ``ancestors`` are nearest first. By default two nodes are NEARBY only if
    their farthest shared ancestor is the lost side's parent; ``nearest`` takes
    the closest shared one instead.
    """
    shared = F.array_intersect(lost["ancestors"], found["ancestors"])
    depth = F.transform(shared, lambda a: F.array_position(lost["ancestors"], a) - 1)
    at = F.array_min(depth) if nearest else F.array_max(depth)
    inside = F.coalesce(F.array_contains(found["ancestors"], lost["id"]), F.lit(False)) | F.coalesce(F.array_contains(lost["ancestors"], found["id"]), F.lit(False))
    return (
        F.when(lost.isNull() | found.isNull(), F.lit(None).cast("string"))
        .when(lost["id"] == found["id"], F.lit("SAME_LOCATION"))
        .when(inside, F.lit("SAME_FACILITY"))
        .when(F.size(shared) > 0, F.when(at == 0, F.lit("NEARBY")).otherwise(F.lit("SAME_AREA")))
    )
