"""Cleaning of recorded tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.series import rolling

PASSES = 10


def clean(track: DataFrame, fastest: float, key: str = "ride_id", t: str = "seq", x: str = "x_mm", y: str = "y_mm", passes: int = PASSES) -> DataFrame:
    """Drops, up to ten times, the later end of each step faster than `fastest` (units of x a unit of t).

    A ride of fewer than three rows is left alone. A pass that drops nothing changes nothing, so the passes can be
    laid out in advance; one partitioning by ride serves them all.
    """
    w = Window.partitionBy(key).orderBy(t)
    every = Window.partitionBy(key)
    for _ in range(passes):
        dt = F.greatest((F.col(t) - F.lag(t).over(w)).cast("double"), F.lit(1e-3))
        d2 = F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)
        bad = F.coalesce(d2 > F.pow(F.lit(fastest) * dt, 2), F.lit(False)) & (F.count(F.lit(1)).over(every) >= 3)
        track = track.withColumn("__bad", bad).where("not __bad").drop("__bad")
    return track


def smooth(track: DataFrame, key: str = "ride_id", t: str = "seq", x: str = "x_mm", y: str = "y_mm", width: int = 5) -> DataFrame:
    """Running medians of both coordinates."""
    w = Window.partitionBy(key).orderBy(t)
    half = width // 2
    return track.withColumn("__x", rolling(F.col(x), w, half, half, "median")).withColumn("__y", rolling(F.col(y), w, half, half, "median")).drop(x, y).withColumnRenamed("__x", x).withColumnRenamed("__y", y)


def clean_distance(track: DataFrame, fastest: float, key: str = "ride_id", t: str = "seq", x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """Path length of each ride after cleaning and smoothing."""
    s = smooth(clean(track, fastest, key, t, x, y), key, t, x, y)
    w = Window.partitionBy(key).orderBy(t)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return s.withColumn("__s", step).groupBy(key).agg(F.coalesce(F.sum("__s"), F.lit(0.0)).alias("distance"))
