"""Change capture on endless input: keyed state instead of a window over history.

Rows may arrive in any order within the watermark, and more than once. Keys are dealt to groups by hash, and a group's
rows wait in list state until the watermark passes them; an event-time timer then releases them, each key's in the order
of their times, so what is kept is what the batch operators keep. A row without a time, older than the watermark, or not
newer than the last released one of its key, changes nothing. A group's state is bounded by the rows that one
watermark delay brings its keys, and a last row per key. Calls between Spark and Python, timers and state cost a group what
they would cost a key, so their number does not grow with keys of few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pedalgrid.constants import MOVE_METERS, RANGE_METERS, STATE_FIELDS
from pedalgrid.functions import drift

#: A key that stands for no station or vehicle: its rows only move the watermark on.
HEARTBEAT = "\x00heartbeat"
#: Column with the number of the group a key is dealt to (rows reach the processor as named tuples: no leading _).
GROUP = "key_group"
#: Groups of a stream whose size is not known, and rows that should wait in one where it is.
GROUPS, GROUP_ROWS = 1024, 1 << 14
#: Most rows in one value of the list state.
CHUNK_ROWS = 1 << 14


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(chunk).read_all().to_pandas()


def _micros(times: pd.Series) -> np.ndarray:
    """Times of the UTC session clock as microseconds."""
    return times.to_numpy("datetime64[us]").view("int64")


def _millis(micros: np.ndarray) -> np.ndarray:
    """The first millisecond not before a time."""
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """Releases a group's rows, each key's in time order, and yields those that :meth:`kept` picks."""

    def __init__(self, key: str, time_col: str):
        self.key, self.time_col = key, time_col

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        # per key the row that its next ones are compared with, under the time of its last released row
        self.last = handle.getValueState("last", "rows binary")

    def kept(self, rows: pd.DataFrame, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``rows`` hold one key after the other, from ``edges`` on, each in time order. Which to keep if a key's first
        one is, and the place of the row that each key's next ones are to be compared with."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for new in rows:  # one group's rows of one micro-batch
            new = new[(new[self.key] != HEARTBEAT) & new[self.time_col].notna()].drop(columns=GROUP)
            if len(new):
                self._wait(new)
                self._wake(new)
        return iter(())

    def _wait(self, rows: pd.DataFrame) -> None:
        for i in range(0, len(rows), CHUNK_ROWS):
            self.waiting.appendValue((_packed(rows.iloc[i : i + CHUNK_ROWS]),))

    def _wake(self, rows: pd.DataFrame) -> None:
        """Have one timer, at the earliest row that waits."""
        due, known = int(_millis(_micros(rows[self.time_col]).min())), list(self.handle.listTimers())
        if not known or due < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        rows = pd.concat([_unpacked(r[0]) for r in self.waiting.get()], ignore_index=True)
        due = _millis(_micros(rows[self.time_col]))
        ready = due <= until
        self.waiting.clear()
        if not ready.all():
            self._wait(rows[~ready])
            self.handle.registerTimer(int(due[~ready].min()))
        if ready.any():
            yield self._released(rows[ready])

    def _released(self, rows: pd.DataFrame) -> pd.DataFrame:
        known = 0
        if self.last.exists():
            last = _unpacked(self.last.get()[0])
            known, rows = len(last), pd.concat([last, rows], ignore_index=True)
        keys, _ = pd.factorize(rows[self.key], use_na_sentinel=False)  # those of ``last`` are 0 .. known - 1
        at = _micros(rows[self.time_col])
        released = np.full(keys.max() + 1, np.iinfo(np.int64).min)
        released[:known] = at[:known]
        fresh = at > released[keys]
        fresh[:known] = True
        order = np.lexsort((at, keys))  # stable: of rows of one key and time the first one counts
        order = order[fresh[order]]
        keys, at = keys[order], at[order]
        new_key = np.append(True, keys[1:] != keys[:-1])
        distinct = new_key | np.append(True, at[1:] != at[:-1])
        order, edges = order[distinct], np.flatnonzero(new_key[distinct])
        rows = rows.iloc[order].reset_index(drop=True)
        keep, compared = self.kept(rows, edges)
        ends = np.append(edges[1:], len(rows)) - 1
        last = rows.iloc[compared].copy()
        last[self.time_col] = rows[self.time_col].to_numpy()[ends]
        self.last.update((_packed(last),))
        return rows[keep & (order >= known)]

    def close(self) -> None:
        pass


class Changes(InOrder):
    """Keeps what differs from the row before; unknown equals unknown."""

    def __init__(self, key: str, time_col: str, fields: Sequence[str]):
        super().__init__(key, time_col)
        self.fields = list(fields)

    def kept(self, rows: pd.DataFrame, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.zeros(len(rows), bool)
        keep[edges] = True
        for f in self.fields:
            now = rows[f].astype("Int64")
            value, unknown = now.fillna(0).to_numpy("int64"), now.isna().to_numpy()
            keep[1:] |= (value[1:] != value[:-1]) | (unknown[1:] != unknown[:-1])
        return keep, np.append(edges[1:], len(rows)) - 1


class Moves(InOrder):
    """Keeps what is far enough from the last kept row."""

    def __init__(self, key: str, time_col: str, move: float, span: int):
        super().__init__(key, time_col)
        self.move, self.span = move, span

    def kept(self, rows: pd.DataFrame, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        columns = [rows[c].to_numpy() for c in drift.PLACE]
        keep, compared = np.zeros(len(rows), bool), []
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True):
            kept = drift.history([c[a:z] for c in columns], self.move, self.span)
            keep[[a + i for i in kept]] = True
            compared.append(a + kept[-1])
        return keep, np.array(compared)


def groups_for(rows: int, least: int) -> int:
    """How many groups keys should be dealt to where about ``rows`` rows wait at a time, ``least`` of them at least."""
    return max(least, math.ceil(rows / GROUP_ROWS))


def _captured(rows: DataFrame, delay: str, groups: int, processor: InOrder) -> DataFrame:
    dealt = rows.withColumn(GROUP, F.pmod(F.xxhash64(processor.key), F.lit(groups)))
    marked = dealt.withWatermark(processor.time_col, delay).groupBy(GROUP)
    return marked.transformWithStateInPandas(processor, rows.schema, "Append", "EventTime")


def cdc_stream(
    rows: DataFrame,
    key: str = "station_id",
    time_col: str = "polled_at",
    fields: Sequence[str] = STATE_FIELDS,
    delay: str = "1 hour",
    groups: int = GROUPS,
) -> DataFrame:
    """Rows whose state differs from the key's row before, whatever order they arrive in within ``delay``.

    A task holds one group's waiting rows at a time. ``groups`` has to stay the same while the stream's progress is kept.
    """
    return _captured(rows, delay, groups, Changes(key, time_col, fields))


def vehicle_stream(
    rows: DataFrame,
    move_m: float = MOVE_METERS,
    range_m: int = RANGE_METERS,
    delay: str = "1 hour",
    groups: int = GROUPS,
) -> DataFrame:
    """Vehicle rows far enough from the last kept row of the vehicle, whatever order they arrive in within ``delay``.

    ``groups`` as in :func:`cdc_stream`.
    """
    return _captured(rows, delay, groups, Moves("bike_id", "observed_at", move_m, range_m))


def heartbeat(like: DataFrame, key: str, time_col: str, at: datetime) -> DataFrame:
    """One row with the columns of ``like`` that moves the watermark to ``at`` less the delay and is no station's or vehicle's."""
    at = at.astimezone(timezone.utc).isoformat()
    known = {key: F.lit(HEARTBEAT), time_col: F.lit(at).cast("timestamp")}
    one = like.sparkSession.range(1)
    return one.select(
        *(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields)
    )
