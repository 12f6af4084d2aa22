"""The phone's features over a stream, with typed state: events, trailing rows and the ring are list states, the clock a value state.

A ride that is silent for `forget` is forgotten by an event-time timer, as a phone starts anew when its sensors have stalled. State is bounded
by the queues' lengths. Needs the RocksDB state store provider (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackloom.operators.features import FeatureStream

OUT = "ride_id long, t double, filled int, " + ", ".join(f"f{i} double" for i in range(6))
_VECTOR = "t double, x double, y double, z double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Features(StatefulProcessor):
    def __init__(self, frame: str, hz: float, rows: int, forget_ms: int):
        self.args, self.forget_ms = (frame, hz, rows), forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = [handle.getListState(name, _VECTOR) for name in ("acceleration", "rates", "gravity")]
        self.trails = [handle.getListState(name, "x double, y double, z double") for name in ("trail_acceleration", "trail_down")]
        self.ring = handle.getListState("ring", ", ".join(f"f{i} double" for i in range(6)))
        self.clock = handle.getValueState("clock", "start double, k long, seen long")

    def _load(self) -> FeatureStream:
        f = FeatureStream(*self.args)
        for held, state in zip(f.grid.held, self.events):
            held.extend((t, np.array(v)) for t, *v in (state.get() if state.exists() else ()))
        for trail, state in zip((f.acc, f.raw), self.trails):
            trail.extend(np.array(v) for v in (state.get() if state.exists() else ()))
        f.ring.extend(np.array(v) for v in (self.ring.get() if self.ring.exists() else ()))
        if self.clock.exists():
            start, f.grid.k, _ = self.clock.get()
            f.grid.start = None if start is None else start
        return f

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _keep(self, f: FeatureStream, seen: int) -> None:
        for held, state in zip(f.grid.held, self.events):
            self._put(state, [(float(t), *map(float, v)) for t, v in held])
        for trail, state in zip((f.acc, f.raw), self.trails):
            self._put(state, [tuple(map(float, v)) for v in trail])
        self._put(self.ring, [tuple(map(float, v)) for v in f.ring])
        self.clock.update((f.grid.start, f.grid.k, seen))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f, out = self._load(), []
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["t", "sensor"], kind="stable")
        for sensor, t, x, y, z in frame[["sensor", "t", "x", "y", "z"]].itertuples(index=False):
            out += [(key[0], due, len(f.ring), *row) for due, row in f.push(int(sensor), float(t), np.array([x, y, z]))]
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        seen = int(frame["ts"].max().value // 1_000_000)
        self.handle.registerTimer(max(seen, timerValues.getCurrentWatermarkInMs()) + self.forget_ms)
        self._keep(f, seen)
        yield pd.DataFrame(out, columns=["ride_id", "t", "filled", *(f"f{i}" for i in range(6))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (*self.events, *self.trails, self.ring, self.clock):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def features(events: DataFrame, frame: str = "replica", hz: float = 10.0, rows: int = 300, watermark: str = "10 seconds", forget_ms: int = 600_000) -> DataFrame:
    """events(ride_id, sensor, t, x, y, z, ts) -> ride_id, t, filled (rows in the ring), f0..f5, as FeatureStream gives them."""
    marked = events.withWatermark("ts", watermark)
    return marked.groupBy("ride_id").transformWithStateInPandas(_Features(frame, hz, rows, forget_ms), OUT, "Append", "EventTime")
