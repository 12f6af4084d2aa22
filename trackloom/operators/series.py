"""Time-series operators over rides: differences, rolling statistics, as-of joins, interpolation, islands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def difference(x: Column, w) -> Column:
    """First difference, 0 at the start."""
    return x - F.coalesce(F.lag(x).over(w), x)


def rolling(x: Column, w, before: int, after: int, how: str) -> Column:
    """Over rows -before..after of the ordered window, with as many rows as there are (min_periods 1)."""
    frame = w.rowsBetween(-before, after)
    if how == "median":
        return F.percentile(x, F.lit(0.5)).over(frame)
    return {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[how](x).over(frame)


def padded_mean(x: Column, w, whole, before: int, after: int) -> Column:
    """Mean over rows -before..after where rows beyond the ends repeat the first or last value; `whole` is the unordered window."""
    n = before + after + 1
    place, size = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    first = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    missing_before, missing_after = F.greatest(F.lit(before + 1) - place, F.lit(0)), F.greatest(place + after - size, F.lit(0))
    return (F.sum(x).over(w.rowsBetween(-before, after)) + first * missing_before + last * missing_after) / F.lit(n)


def gradient(x: Column, w) -> Column:
    """Central difference, one-sided at the ends, 0 for a single row; unit spacing."""
    back, ahead = F.lag(x).over(w), F.lead(x).over(w)
    return F.coalesce((ahead - back) / F.lit(2.0), (ahead - x) / F.lit(1.0), (x - back) / F.lit(1.0), F.lit(0.0))


def gradient_over(x: Column, t: Column, w) -> Column:
    """The same for uneven spacing t, second order inside."""
    h0, h1 = t - F.lag(t).over(w), F.lead(t).over(w) - t
    y0, y1 = F.lag(x).over(w), F.lead(x).over(w)
    inner = (h0 * h0 * y1 + (h1 * h1 - h0 * h0) * x - h1 * h1 * y0) / (h0 * h1 * (h0 + h1))
    return F.coalesce(inner, (y1 - x) / h1, (x - y0) / h0, F.lit(0.0))


def wrap_degrees(x: Column) -> Column:
    """Whole degrees to -180 (exclusive) .. 180."""
    y = F.pmod(x, F.lit(360))
    return F.when(y > 180, y - 360).otherwise(y)


def unwrap_degrees(x: Column, w) -> Column:
    """Whole degrees without jumps of more than half a turn; a jump of exactly -180 becomes +180 only if it went up."""
    d = x - F.lag(x).over(w)
    y = F.pmod(d + 180, F.lit(360)) - 180
    y = F.when((y == -180) & (d > 0), F.lit(180)).otherwise(y)
    turn = F.when(F.abs(d) < 180, F.lit(0)).otherwise(y - d)
    return turn


def with_unwrapped(df: DataFrame, col: str, out: str, key: str, order: str) -> DataFrame:
    w = ordered(key, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__turn", unwrap_degrees(F.col(col), w)).withColumn(out, F.col(col) + F.coalesce(F.sum("__turn").over(run), F.lit(0))).drop("__turn")


def asof(left: DataFrame, right: DataFrame, key: str, t: str, cols: list[str], tolerance: float | None = None) -> DataFrame:
    """left and, of right's rows at or before its t, the latest one's cols (and its time as right_t).

    One shuffle of the union of both sides; a merge in order instead of a range join. At equal times right comes
    first. Keys must be unique per (key, t) on the right.
    """
    names = left.columns
    r = right.select(F.col(key), F.col(t), F.lit(0).alias("__side"), F.struct(F.col(t).alias("right_t"), *cols).alias("__r"))
    both = left.withColumn("__side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = ordered(key, t, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    if tolerance is not None:
        found = found.withColumn("__m", F.when(F.col(t) - F.col("__m.right_t") <= tolerance, F.col("__m")))
    return found.select(*names, "__m.right_t", *[F.col(f"__m.{c}").alias(c) for c in cols])


def bracket(grid: DataFrame, samples: DataFrame, key: str, t: str, col: str) -> DataFrame:
    """grid(key, t) with the sample before (t0, v0) and after (t1, v1); at a sample's own time both are that sample."""
    s = samples.select(key, t, F.lit(True).alias("__sample"), F.struct(F.col(t).alias("t"), F.col(col).alias("v")).alias("__s"))
    both = grid.select(key, t, F.lit(False).alias("__sample")).unionByName(s, allowMissingColumns=True)
    before = ordered(key, t).rangeBetween(Window.unboundedPreceding, 0)
    after = ordered(key, t).rangeBetween(0, Window.unboundedFollowing)
    found = both.select("*", F.last("__s", True).over(before).alias("lo"), F.first("__s", True).over(after).alias("hi")).where(~F.col("__sample"))
    return found.select(key, t, F.col("lo.t").alias("t0"), F.col("lo.v").alias("v0"), F.col("hi.t").alias("t1"), F.col("hi.v").alias("v1"))


def interpolate(grid: DataFrame, samples: DataFrame, key: str, t: str, col: str) -> DataFrame:
    """Linear interpolation of samples at grid times, held at the ends: key, t, col."""
    b = bracket(grid, samples, key, t, col)
    inner = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(t) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    value = F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull(), F.col("v0")).when(F.col("t0") == F.col("t1"), F.col("v0")).otherwise(inner)
    return b.select(key, t, value.alias(col))


def nearest(left: DataFrame, right: DataFrame, key: str, t: str, col: str) -> DataFrame:
    """left(key, t) with the value of the sample nearest in time, the earlier one if two are as near."""
    b = bracket(left, right, key, t, col)
    earlier = F.coalesce(F.col(t) - F.col("t0") <= F.col("t1") - F.col(t), F.col("t1").isNull())
    return b.select(key, t, F.when(earlier, F.col("t0")).otherwise(F.col("t1")).alias("near_t"), F.when(earlier, F.col("v0")).otherwise(F.col("v1")).alias(col))


def islands(df: DataFrame, flag: Column, key: str, order: str, out: str = "island") -> DataFrame:
    """Numbers the runs of equal flag within a key, from 1."""
    w = ordered(key, order)
    starts = F.when(F.lag(flag).over(w).eqNullSafe(flag), 0).otherwise(1)
    return df.withColumn("__starts", starts).withColumn(out, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def sessions(df: DataFrame, gap: Column, key: str, *order: str, out: str = "session") -> DataFrame:
    """Numbers the sessions of a key: a row where gap is true begins a new one; from 1."""
    w = ordered(key, *order)
    return df.withColumn("__new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def first_sustained(df: DataFrame, mask: Column, key: str, t: str, hold: float) -> DataFrame:
    """Of each key, the first time at which mask has held for `hold` without a break: key, t (null if never)."""
    runs = islands(df.withColumn("__mask", mask), F.col("__mask"), key, t, "__run")
    held = runs.withColumn("__began", F.min(t).over(Window.partitionBy(key, "__run")))
    hit = F.when(F.col("__mask") & (F.col(t) - F.col("__began") >= hold), F.col(t))
    return held.groupBy(key).agg(F.min(hit).alias(t))


def trailing_windows(df: DataFrame, col: str, key: str, order: str, size: int, stride: int) -> DataFrame:
    """Full windows of `size` rows that begin at every stride-th row: key, order, window (array)."""
    w = ordered(key, order).rowsBetween(0, size - 1)
    return df.withColumn("window", F.collect_list(col).over(w)).where((F.col(order) % stride == 0) & (F.size("window") == size)).select(key, order, "window")


def decimate(df: DataFrame, order: str, factor: int) -> DataFrame:
    return df.where(F.col(order) % factor == 0)


def stairs(df: DataFrame, col: str, key: str, order: str) -> DataFrame:
    """df and new: whether a held value is a new one."""
    before = F.lag(F.struct(col)).over(ordered(key, order))
    return df.withColumn("new", ~F.coalesce(before[col].eqNullSafe(F.col(col)) & before.isNotNull(), F.lit(False)))


def half_width(rows: DataFrame, events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, event, width: how long the value stays at half of an event's peak or more around its apex, without a break.

    rows(key, order, value), events(key, event, t0, t1, apex, peak). Order counts in whole steps; within t0..t1.
    """
    inside = rows.join(events, key).where(F.col(order).between(F.col("t0"), F.col("t1")))
    low = F.col(value) * 2 < F.col("peak")
    g = inside.groupBy(key, "event").agg(F.max(F.when(low & (F.col(order) < F.col("apex")), F.col(order))).alias("lo"), F.min(F.when(low & (F.col(order) > F.col("apex")), F.col(order))).alias("hi"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return g.select(key, "event", (F.coalesce(F.col("hi") - 1, "t1") - F.coalesce(F.col("lo") + 1, "t0") + 1).alias("width"))


def dominant_frequency(windows: DataFrame, hz: float, least: int = 8, above: float = 1.0) -> DataFrame:
    """windows(..., window: array<double>) and frequency: where the spectrum of the window, less its mean and under a Hann taper, is largest above
    `above` Hz and below half the rate; null with fewer than `least` samples or no such line; of equal lines the lowest.

    Windows of any lengths; those of one length are one batched real FFT.
    """

    def loudest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for windows_ in batches:
            n = windows_.map(lambda w: 0 if w is None else len(w)).to_numpy()
            out = np.full(len(n), np.nan)
            for size in np.unique(n[n >= least]):
                at = np.flatnonzero(n == size)
                w = np.stack([np.asarray(windows_.iloc[i], float) for i in at])
                line = np.arange(size // 2 + 1)
                band = np.flatnonzero((line * hz > above * size) & (2 * line < size))
                if len(band):
                    loud = np.abs(np.fft.rfft((w - w.mean(1, keepdims=True)) * np.hanning(size), axis=1))[:, band]
                    out[at] = band[loud.argmax(1)] * hz / size
            yield pd.Series(out)

    found = F.pandas_udf(loudest, "double")(F.col("window"))
    return windows.withColumn("frequency", F.when(~F.isnan(found), found))
