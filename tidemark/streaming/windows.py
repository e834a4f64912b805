"""Sliding windows over a count of records, of a table and of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.ordering import global_position

# ---- fixed values -----------------------------------------------------------
WINDOW_ROWS, WINDOW_STEP = 1000, 200
# ---- end of fixed values ----------------------------------------------------
# State holds rows in packs of this many; rows of windows given out together.
PACKED, PACKED_ROWS, OUTPUT_ROWS = "rows binary", 50_000, 200_000


def sliding_count_windows(
    rows: DataFrame, size: int = WINDOW_ROWS, step: int = WINDOW_STEP,
    order: tuple[str, str] = ("tpep_pickup_datetime", "id"),
) -> DataFrame:
    """Each row with every window of the last ``size`` rows it belongs to.

    Windows close at row ``size`` and every ``step`` rows after; a last one
    holds the final ``size`` rows (all rows, when there are fewer).  Adds
    ``window_index``; a row is copied at most ``size / step + 2`` times.
    """
    placed = global_position(rows, list(order))
    # one row
    total = placed.agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(F.broadcast(total), how="cross")
    pos, n = F.col("_pos"), F.col("_n")
    full = F.greatest(F.floor((n - size) / step) + 1, F.lit(0))
    first = F.greatest(F.ceil((pos - size + 1) / step), F.lit(0))
    last = F.least(F.floor(pos / step), full - 1)
    within = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    at_end = F.when(pos >= n - size, F.array(full.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return placed.withColumn("window_index", F.explode(F.concat(within, at_end))).drop("_pos", "_n")


class CountWindows(StatefulProcessor):
    """Per key: rows wait until the watermark has passed them, then take their place in the order of time and id.

    State holds the waiting rows, the newest rows that later windows reach back
    to, and how many rows have taken their place.
    """

    def __init__(self, keys: list[str], columns: list[str], schema: T.StructType, size: int, step: int, order: tuple[str, str]):
        self.keys, self.columns, self.schema = keys, columns, schema
        self.size, self.step, self.order = size, step, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED)
        self.newest = handle.getListState("newest", PACKED)
        self.placed = handle.getValueState("placed", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[self.columns]
        late = new[self.order[0]] <= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        yield from self._advance(key, new[~late], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, None, timerValues)

    def _frame(self, state) -> pd.DataFrame:
        parts = [pa.ipc.open_stream(r[0]).read_pandas() for r in state.get()] if state.exists() else []
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=self.columns)

    def _put(self, state, frame: pd.DataFrame) -> None:
        """Rows are kept packed, ``PACKED_ROWS`` together, so that they come and go without a Python object each."""
        state.clear()
        for start in range(0, len(frame), PACKED_ROWS):
            table = pa.Table.from_pandas(frame.iloc[start:start + PACKED_ROWS], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            state.appendValue((sink.getvalue().to_pybytes(),))

    def _advance(self, key, new: pd.DataFrame | None, timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in (self._frame(self.waiting), new) if p is not None and len(p)]
        if not parts:
            return
        ts = self.order[0]
        rows = pd.concat(parts, ignore_index=True)
        closed = rows[ts] <= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        ready, waiting = rows[closed].sort_values(self.order), rows[~closed]
        if new is not None or len(ready):
            self._put(self.waiting, waiting)
        if len(waiting):
            self.handle.registerTimer(int(np.ceil(waiting[ts].min().value / 1e6)))
        if not len(ready):
            return
        n = int(self.placed.get()[0]) if self.placed.exists() else 0
        kept = self._frame(self.newest)
        held = pd.concat([p for p in (kept, ready) if len(p)], ignore_index=True)
        start, end = n - len(kept), n + len(ready)  # places of the rows at hand
        first, last = max(-(-(n + 1 - self.size) // self.step), 0), (end - self.size) // self.step + 1
        # many windows a frame, a frame of bounded size
        at_once = max(OUTPUT_ROWS // self.size, 1)
        for begin in range(first, last, at_once):
            index = np.arange(begin, min(begin + at_once, last))
            low = index * self.step - start
            out = held.iloc[(low[:, None] + np.arange(self.size)).ravel()]
            out = out.assign(window_index=np.repeat(index, self.size), **dict(zip(self.keys, key)))
            yield out[[*self.keys, *self.columns, "window_index"]]
        self.placed.update((end,))
        self._put(self.newest, held.tail(self.size - 1) if self.size > 1 else held.iloc[:0])

    def close(self) -> None:
        pass


def stream_count_windows(
    stream: DataFrame, keys: list[str], size: int = WINDOW_ROWS, step: int = WINDOW_STEP, delay: str = "1 hour",
    order: tuple[str, str] = ("tpep_pickup_datetime", "id"),
) -> DataFrame:
    """The stream form of :func:`sliding_count_windows`, per key: rows of each window of ``size`` rows, in order of time.

    A window is given out once the watermark has passed its last row, so rows
    that come out of order within ``delay`` are in their place; later ones are
    left out.  Rows that do not fill a window yet stay in the state, which holds
    per key the rows within the delay and the newest ``size``.  Needs the RocksDB
    state store.  One key's rows are ordered in one task, so name keys that
    share the load.
    """
    columns = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*[stream.schema[k] for k in keys], *[stream.schema[c] for c in columns],
                           T.StructField("window_index", T.LongType())])
    return stream.withWatermark(order[0], delay).groupBy(*keys).transformWithStateInPandas(
        CountWindows(keys, columns, schema, size, step, order), schema, "Append", "EventTime")
