"""Histories of rows that are kept when they are far enough from the last kept row.

The rule is sequential: what is kept next depends on the last kept row, its anchor. But the anchor that reaches
a piece of a history is close to the row just before the piece, so the first row kept in the piece lies in its
*zone*, the rows up to the first one that is far from every such anchor. A piece is therefore worked off for all rows
of its zone as first kept row at once, before anyone knows which is the right one. Histories that
once keep the same row agree from there on, so they cost little more than one. What a piece is to the
vehicle is then a small map, first kept row to last kept row, and the maps are applied in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pandas as pd

from pedalgrid.constants import EARTH_RADIUS_KM, MOVE_METERS, RANGE_METERS

PLACE = ["lat", "lon", "range_m", "is_disabled", "is_reserved"]
#: First and largest number of rows compared with an anchor at once.
STEP, MOST = 16, 1 << 16


def meters(lat1, lon1, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    north, east = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    chord = np.sin(north) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(east) ** 2
    return 2000 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(chord, 1.0)))


def far(anchor: Sequence, rows: Sequence[np.ndarray], move: float = MOVE_METERS, span: float = RANGE_METERS) -> np.ndarray:
    """Which of ``rows`` (the columns PLACE) are far enough from ``anchor`` to be kept."""
    lat, lon, reach, disabled, reserved = rows
    apart = (disabled != anchor[3]) | (reserved != anchor[4]) | (np.abs(reach - anchor[2]) >= span)
    return apart | (meters(anchor[0], anchor[1], lat, lon) >= move)


def plain(rows: Sequence[np.ndarray]) -> list[tuple]:
    """The rows as tuples of plain numbers, which are quicker than arrays for a few rows at a time."""
    return list(zip(*(c.tolist() for c in rows), strict=True))


def _far(a: tuple, b: tuple, move: float, span: float) -> bool:
    """:func:`far` of one row."""
    if a[3] != b[3] or a[4] != b[4] or abs(b[2] - a[2]) >= span:
        return True
    north, east = radians(b[0] - a[0]) / 2, radians(b[1] - a[1]) / 2
    chord = sin(north) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(east) ** 2
    return 2000 * EARTH_RADIUS_KM * asin(sqrt(min(chord, 1.0))) >= move


def next_kept(rows: Sequence[np.ndarray], at: int, move: float, span: float, tuples: list[tuple] | None = None) -> int:
    """The first row after ``at`` that is kept if ``at`` is; the number of rows if none is.

    The next few rows are looked at one by one (``tuples``: the same rows, :func:`plain`), those behind them in blocks.
    """
    tuples = plain(rows) if tuples is None else tuples
    own = tuples[at]
    for i in range(at + 1, min(at + 1 + STEP, len(tuples))):
        if _far(own, tuples[i], move, span):
            return i
    anchor, i, step = [c[at] for c in rows], at + 1 + STEP, 2 * STEP
    while i < len(rows[0]):
        hit = far(anchor, [c[i : i + step] for c in rows], move, span)
        if hit.any():
            return i + int(hit.argmax())
        i, step = i + step, min(2 * step, MOST)
    return len(rows[0])


def zone(before: Sequence | None, rows: Sequence[np.ndarray], move: float, span: float) -> int:
    """How many rows of a piece may be the first that is kept. ``before`` is the row before the piece."""
    if before is None:
        return 1
    hit = far(before, rows, 2 * move + 0.001, 2 * span)
    return int(hit.argmax()) + 1 if hit.any() else len(hit)


def history(rows: Sequence[np.ndarray], move: float, span: float) -> list[int]:
    """The rows that are kept if the first one is."""
    tuples, kept, i = plain(rows), [], 0
    while i < len(tuples):
        kept.append(i)
        i = next_kept(rows, i, move, span, tuples)
    return kept


def histories(rows: Sequence[np.ndarray], first: int, move: float, span: float) -> tuple[dict[int, list[int]], list[int]]:
    """For all first kept rows 0 .. ``first`` - 1: the rows that any of these histories keeps, each with the
    list of first rows whose history keeps it, and the last row of each history."""
    after: dict[int, int] = {}
    tuples = plain(rows)
    for start in range(first):
        i = start
        while i < len(rows[0]) and i not in after:
            after[i] = next_kept(rows, i, move, span, tuples)
            i = after[i]
    kept: dict[int, list[int]] = {i: [i] if i < first else [] for i in sorted(after)}
    last = [0] * first
    for i in kept:
        if after[i] < len(rows[0]):
            kept[after[i]] += kept[i]
        else:
            for start in kept[i]:
                last[start] = i
    return kept, last


def whole_pieces(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Sorted rows, regrouped so that no value of ``keys`` is in two frames; each with the (start, end) of its values."""
    held: list[pd.DataFrame] = []

    def whole() -> tuple[pd.DataFrame, list[tuple[int, int]]]:
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        edges = np.flatnonzero(new).tolist()
        return frame, list(zip(edges, [*edges[1:], len(frame)], strict=True))

    for b in batches:
        if b.empty:
            continue
        new = (b[keys] != b[keys].shift()).any(axis=1).to_numpy()
        new[0] = bool(held) and (held[-1][keys].iloc[-1] != b[keys].iloc[0]).any()
        edges = np.flatnonzero(new)
        if not len(edges):
            held.append(b)
            continue
        if edges[-1]:
            held.append(b.iloc[: edges[-1]])
        yield whole()
        held = [b.iloc[edges[-1] :]]
    if held:
        yield whole()


def pieces(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows, regrouped so that each frame holds all rows of one value of ``keys``."""
    for frame, edges in whole_pieces(batches, keys):
        for start, end in edges:
            yield frame.iloc[start:end]
