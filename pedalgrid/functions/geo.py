"""Great-circle distance and distance-preserving cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedalgrid.constants import EARTH_RADIUS_KM


def haversine(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_KM
) -> Column:
    """Distance on a sphere, in the unit of ``radius``."""
    north = F.radians(lat2 - lat1) / 2
    east = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(north), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(east), 2
    )
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2 * radius)


def sphere_cell(lat: Column, lon: Column, size_km: float) -> Column:
    """The cube of side ``size_km`` that holds a point of the sphere.

    A chord is never longer than its arc, so two points at most ``size_km`` apart
    lie in the same or in touching cubes, at every latitude.
    """
    phi, lam = F.radians(lat), F.radians(lon)
    axes = (
        ("x", F.cos(phi) * F.cos(lam)),
        ("y", F.cos(phi) * F.sin(lam)),
        ("z", F.sin(phi)),
    )
    return F.struct(
        *(F.floor(v * (EARTH_RADIUS_KM / size_km)).cast("int").alias(n) for n, v in axes)
    )


def touching_cells(cell: str) -> Column:
    """Array of the cell in column ``cell`` and its 26 neighbours."""
    at = F.col(cell)

    def neighbour(i: Column) -> Column:
        return F.struct(
            (at["x"] + (i % 3 - 1)).alias("x"),
            (at["y"] + (F.floor(i / 3).cast("int") % 3 - 1)).alias("y"),
            (at["z"] + (F.floor(i / 9).cast("int") - 1)).alias("z"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(26)), neighbour)
