"""Dead-reckoning predictors: where the ride is believed to be during an outage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Predictors that need only the state at the cut: name -> (x, y, sigma in mm) from x0, y0, vx, vy, dt.
CLOSED: dict[str, Callable[[Column, Column, Column, Column, Column], tuple[Column, Column, Column]]] = {
    "frozen": lambda x0, y0, vx, vy, dt: (x0 + vx * 0, y0 + vy * 0, 1000.0 + dt * 0),
    "constant_velocity": lambda x0, y0, vx, vy, dt: (x0 + vx * dt, y0 + vy * dt, 1000.0 + 500.0 * dt),
}


def steps(outages: DataFrame, path: DataFrame, init: DataFrame, key: str = "ride_id") -> DataFrame:
    """A row per outage and step in [i0, i1] of path(key, seq, ...), with the state x0, y0, vx, vy at i0. An equi-join on key and step: only rows that stay are formed."""
    o = outages.join(init.select(key, F.col("seq").alias("i0"), "x0", "y0", "vx", "vy"), [key, "i0"])
    return o.withColumn("seq", F.explode(F.sequence("i0", "i1"))).join(path, [key, "seq"])


def predict_closed(outages: DataFrame, path: DataFrame, init: DataFrame, names: list[str] | None = None, key: str = "ride_id") -> DataFrame:
    """A row per outage, predictor and step in [i0, i1]: key, target, i0, i1, predictor, seq, x, y, sigma (mm), true x_mm, y_mm."""
    names = names or list(CLOSED)
    rows = steps(outages, path.select(key, "seq", "x_mm", "y_mm"), init, key)
    dt = (F.col("seq") - F.col("i0")).cast("double")
    args = (F.col("x0"), F.col("y0"), F.col("vx"), F.col("vy"), dt)
    each = F.array(*[F.struct(F.lit(n).alias("predictor"), *[c.cast("double").alias(a) for c, a in zip(CLOSED[n](*args), ("x", "y", "sigma"))]) for n in names])
    return rows.select(key, "target", "i0", "i1", "seq", "x_mm", "y_mm", F.explode(each).alias("e")).select(key, "target", "i0", "i1", "e.*", "seq", "x_mm", "y_mm")


def integrate(outages: DataFrame, path: DataFrame, init: DataFrame, accel: str, turn_deg: str, key: str = "ride_id") -> DataFrame:
    """Naive integration: speed |v0| plus summed acceleration, never below 0; heading plus summed turns; one-second steps."""
    rows = steps(outages, path.select(key, "seq", F.col(accel).alias("__a"), F.col(turn_deg).alias("__w"), "x_mm", "y_mm"), init, key)
    run = Window.partitionBy(key, "target", "i0", "i1").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("v", F.greatest(F.hypot("vx", "vy") + F.sum("__a").over(run), F.lit(0.0)))
    start = F.when(F.hypot("vx", "vy") > 100, F.atan2("vy", "vx")).otherwise(F.lit(0.0))
    rows = rows.withColumn("h", start + F.radians(F.sum("__w").over(run)))
    t = F.col("seq") - F.col("i0")
    return rows.select(key, "target", "i0", "i1", F.lit("integrate").alias("predictor"), (F.col("x0") + F.sum(F.col("v") * F.cos("h")).over(run)).alias("x"), (F.col("y0") + F.sum(F.col("v") * F.sin("h")).over(run)).alias("y"), (50.0 * t * t + 1000.0).alias("sigma"), "seq", "x_mm", "y_mm")


def problems(predicted: DataFrame, all_rows: bool = False) -> DataFrame:
    """Breaches of the predictor contract: places and sigmas that are missing, not finite or negative."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    found = F.filter(F.array(F.when(bad("x"), "x"), F.when(bad("y"), "y"), F.when(bad("sigma") | (F.col("sigma") < 0), "sigma")), lambda p: p.isNotNull())
    marked = predicted.withColumn("problems", found)
    return marked if all_rows else marked.where(F.size("problems") > 0)
