"""Structured Streaming twins: the step functions of the folds with their state kept by Spark, and windowed counts.

Events later than the watermark are dropped; a fix older than ten seconds on arrival is STALE in FixFilter as well.
State has a fixed size per ride and goes when a ride has been silent for `forget`.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stateful(stream: DataFrame, key: str, order: str, time: str, start: Callable[[], Any], step: Callable[[Any, dict], dict | list[dict] | None], schema: str, names: list[str], watermark: str = "10 seconds", forget_ms: int = 600_000) -> DataFrame:
    """The fold over a stream. Rows of a batch are put in order within their key; order across batches is arrival."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = pickle.loads(state.get[0]) if state.exists else start()
        frame = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        out: list[dict] = []
        for row in frame.to_dict("records"):
            got = step(kept, row)
            if got:
                out += [{key: k[0], **r} for r in (got if isinstance(got, list) else [got])]
        state.update((pickle.dumps(kept),))
        state.setTimeoutTimestamp(max(int(frame[time].max().value // 1_000_000), state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame(out, columns=names)

    marked = stream.withWatermark(time, watermark)
    return marked.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def sampled(stream: DataFrame, time: str, every: str = "5 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Tumbling performance samples: count, mean and worst value in each window."""
    g = stream.withWatermark(time, watermark).groupBy(F.window(time, every))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("worst")).select("window.start", "window.end", "n", "mean", "worst")


def passes(stream: DataFrame, key: str, time: str, gap: str = "8 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Sessions of a key: how long it was near, and how often."""
    g = stream.withWatermark(time, watermark).groupBy(key, F.session_window(time, gap))
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
