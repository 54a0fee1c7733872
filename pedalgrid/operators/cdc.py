"""Change data capture: full series of polls to rows that changed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalgrid.constants import MOVE_METERS, RANGE_METERS, STATE_FIELDS
from pedalgrid.functions import drift
from pedalgrid.functions.ordered import sliced_lag, time_slices
from pedalgrid.functions.picking import latest_per
from pedalgrid.session import cut_lineage, shuffle_width


def cdc_flags(
    series: DataFrame,
    key: str = "station_id",
    time_col: str = "polled_at",
    fields: Sequence[str] = STATE_FIELDS,
) -> DataFrame:
    """Mark every row that differs from the key's row before; the first one always does.

    Unknown equals unknown. As equality carries over, the row before may stand for the
    last kept one.
    """
    steps = sliced_lag(series, [key], time_col, fields)
    same = F.col("prev").eqNullSafe(F.struct(*fields))
    return steps.withColumn("changed", ~same).drop("prev")


def cdc_batch(series: DataFrame, **kwargs) -> DataFrame:
    return cdc_flags(series, **kwargs).filter("changed").drop("changed")


def cdc_incremental(
    snapshot: DataFrame,
    current: DataFrame,
    key: str = "station_id",
    fields: Sequence[str] = STATE_FIELDS,
) -> DataFrame:
    """Snapshot rows that are new or differ from the stored state; absent keys leave no trace."""
    known = current.select(key, F.struct(*fields).alias("known"))
    same = F.col("known").eqNullSafe(F.struct(*fields))
    return snapshot.join(known, key, "left").filter(~same).select(*snapshot.columns)


def cdc_latest(
    kept: DataFrame,
    key: str = "station_id",
    time_col: str = "polled_at",
    fields: Sequence[str] = STATE_FIELDS,
) -> DataFrame:
    """The current state per key; its time is the last change, not the last poll."""
    return latest_per(kept, [key], time_col, [time_col, *fields])


def cdc_stats(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.count("*").alias("rows_read"), F.count_if("changed").alias("rows_kept")
    ).select(
        "rows_read",
        "rows_kept",
        (F.col("rows_read") - F.col("rows_kept")).alias("rows_dropped"),
        F.try_divide("rows_kept", "rows_read").alias("kept_share"),
    )


def poll_summary(polls: DataFrame, flags: DataFrame) -> DataFrame:
    """Per poll: stations seen, changed and unchanged. A failed poll saw nothing."""
    per_poll = flags.groupBy("polled_at").agg(
        F.count("*").alias("seen"), F.count_if("changed").alias("written")
    )
    good = F.col("status") == "ok"

    def of(col: str) -> Column:
        return F.when(good, F.coalesce(col, F.lit(0))).otherwise(0)

    return polls.join(per_poll, "polled_at", "left").select(
        "polled_at",
        "status",
        of("seen").alias("stations_seen"),
        of("written").alias("rows_written"),
        (of("seen") - of("written")).alias("unchanged"),
        "error",
    )


#: A vehicle with more rows than this that differ from the row before is cut into pieces by time.
PIECE_ROWS = 1000

VEHICLE = ["bike_id", "observed_at", "lat", "lon", "range_m", "is_disabled", "is_reserved"]


def vehicle_rows(raw: DataFrame) -> DataFrame:
    """Vehicles with an id and a position; an unknown range or flag counts as zero."""
    usable = (
        F.col("bike_id").isNotNull()
        & (F.col("bike_id") != "")
        & F.col("lat").isNotNull()
        & F.col("lon").isNotNull()
    )

    def number(c: str) -> Column:
        return F.coalesce(F.col(c).cast("int"), F.lit(0))

    return raw.filter(usable).select(
        "bike_id",
        "observed_at",
        "lat",
        "lon",
        number("current_range_meters").alias("range_m"),
        number("is_disabled").alias("is_disabled"),
        number("is_reserved").alias("is_reserved"),
    )


def _kept(batches: Iterator[pd.DataFrame], move: float, span: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bike_id, time), all of a vehicle's: those that are kept."""
    for frame, edges in drift.whole_pieces(batches, ["bike_id"]):
        rows = [frame[c].to_numpy() for c in drift.PLACE]
        kept = [a + i for a, z in edges for i in drift.history([c[a:z] for c in rows], move, span)]
        yield frame.iloc[kept][VEHICLE]


def _speculated(batches: Iterator[pd.DataFrame], move: float, span: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bike_id, slice, time). Of each piece the rows that it keeps for any first kept row; ``of``
    lists those first rows by number, ``entry`` is a first row's own number, ``last_*`` its history's last row."""
    for frame, edges in drift.whole_pieces(batches, ["bike_id", "slice"]):
        columns = [frame[c].to_numpy() for c in drift.PLACE]
        begins, before = frame["begins"].to_numpy(), [frame[f"before_{c}"].to_numpy() for c in drift.PLACE]
        at, entry, of, ends = [], [], [], []
        for a, z in edges:
            rows = [c[a:z] for c in columns]
            first = drift.zone(None if begins[a] else [c[a] for c in before], rows, move, span)
            kept, last = drift.histories(rows, first, move, span)
            at += [a + i for i in kept]
            entry += [i if i < first else None for i in kept]
            of += kept.values()
            ends += [a + (last[i] if i < first else i) for i in kept]
        out = frame.iloc[at][[*VEHICLE, "slice"]].copy()
        out["entry"] = pd.array(entry, "Int32")
        out["of"] = of
        for c, column in zip(drift.PLACE, columns, strict=True):
            out[f"last_{c}"] = column[ends]
        yield out


def _composed(batches: Iterator[pd.DataFrame], move: float, span: int) -> Iterator[pd.DataFrame]:
    """Possible first rows sorted by (bike_id, slice, entry): those that are the right ones, piece by piece."""
    bike, anchor = None, None
    for frame, edges in drift.whole_pieces(batches, ["bike_id", "slice"]):
        columns, bikes = [frame[c].to_numpy() for c in drift.PLACE], frame["bike_id"].to_numpy()
        lasts, right = [frame[f"last_{c}"].to_numpy() for c in drift.PLACE], []
        for a, z in edges:
            if bikes[a] != bike:
                bike, anchor = bikes[a], None
            rows = [c[a:z] for c in columns]
            hit = np.array([True]) if anchor is None else drift.far(anchor, rows, move, span)
            if hit.any():
                i = a + int(hit.argmax())
                anchor = [c[i] for c in lasts]
                right.append(i)
        yield frame.iloc[right][["bike_id", "slice", "entry"]]


def cdc_threshold(
    vehicles: DataFrame, move_m: float = MOVE_METERS, range_m: int = RANGE_METERS
) -> DataFrame:
    """Vehicle rows that moved, changed range or changed a flag since the last kept row.

    The rule looks at the last *kept* row, so slow drift adds up and no window can tell. Repeats of the row
    before are never kept and go first. A vehicle of few rows is then gone through as it is; the
    history of any other is cut into pieces, one per time range, that are worked off independently for every row
    that may be the first kept one (:mod:`pedalgrid.functions.drift`); only the maps from first to last
    kept rows are gone through in order, a few rows per piece. So a vehicle that drifts for its whole
    history is spread like any other.
    """
    cut = time_slices(vehicles, "observed_at")
    fields = drift.PLACE
    steps = sliced_lag(vehicles, ["bike_id"], "observed_at", fields, slice_col=cut)
    before = [F.col(f"prev.{c}").alias(f"before_{c}") for c in fields]
    changed = steps.filter(~F.col("prev").eqNullSafe(F.struct(*fields)))
    fresh = cut_lineage(changed.select(*VEHICLE, F.col("prev").isNull().alias("begins"), *before), "fresh")
    width = shuffle_width(vehicles.sparkSession)
    types = dict(vehicles.dtypes)
    columns = ", ".join(f"{c} {types[c]}" for c in VEHICLE)
    lasts = ", ".join(f"last_{c} {types[c]}" for c in fields)
    rows_of = fresh.groupBy("bike_id").agg(F.count("*").alias("rows"))
    long = F.broadcast(rows_of.filter(F.col("rows") > PIECE_ROWS).select("bike_id"))  # one in PIECE_ROWS rows at most
    short_kept = (
        fresh.select(VEHICLE)
        .join(long, "bike_id", "left_anti")
        .repartition("bike_id")
        .sortWithinPartitions("bike_id", "observed_at")
        .mapInPandas(lambda batches: _kept(batches, move_m, range_m), columns)
    )
    speculated = cut_lineage(
        fresh.join(long, "bike_id", "left_semi")
        .withColumn("slice", cut)
        .repartition(width, "bike_id", "slice")
        .sortWithinPartitions("bike_id", "slice", "observed_at")
        .mapInPandas(
            lambda batches: _speculated(batches, move_m, range_m),
            f"{columns}, slice int, entry int, of array<int>, {lasts}",
        ),
        "speculated",
    )
    right = (
        speculated.filter("entry IS NOT NULL")
        .drop("of", "observed_at")
        .repartition(width, "bike_id")
        .sortWithinPartitions("bike_id", "slice", "entry")
        .mapInPandas(
            lambda batches: _composed(batches, move_m, range_m), f"bike_id {types['bike_id']}, slice int, entry int"
        )
    )
    known = speculated.drop("entry").join(right, ["bike_id", "slice"])
    long_kept = known.filter(F.array_contains("of", F.col("entry"))).select(*VEHICLE)
    return short_kept.unionByName(long_kept)
