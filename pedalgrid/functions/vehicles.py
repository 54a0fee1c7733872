"""The rule for a vehicle row that is worth keeping, shared by batch and stream."""

from __future__ import annotations

import math

from pedalgrid.constants import EARTH_RADIUS_KM, MOVE_METERS, RANGE_METERS


def meters(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    north, east = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    chord = math.sin(north) ** 2
    chord += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(east) ** 2
    return 2000 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(chord, 1.0)))


def differs(anchor, row, move: float = MOVE_METERS, span: int = RANGE_METERS) -> bool:
    """Whether ``row`` is far enough from the last kept row, or there is none."""
    return (
        anchor is None
        or anchor.is_disabled != row.is_disabled
        or anchor.is_reserved != row.is_reserved
        or abs(anchor.range_m - row.range_m) >= span
        or meters(anchor.lat, anchor.lon, row.lat, row.lon) >= move
    )
