"""Simulated outages of satellite positioning: intervals [i0, i1] of a ride, both ends included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_at_or_after(targets: DataFrame, path: DataFrame, key: str, target: str, along: str, place: str, out: str) -> DataFrame:
    """targets and, of the rows of path where `along` has reached the target, the least `place` (a search in a sorted array).

    Both sides are merged in order within the key; rows of path that never reach a target drop it.
    """
    p = path.select(key, F.col(along).alias("__at"), F.lit(1).alias("__side"), F.col(place).alias("__place"))
    t = targets.withColumn("__at", F.col(target)).withColumn("__side", F.lit(0))
    both = t.unionByName(p, allowMissingColumns=True)
    # `along` never falls, so the first row ahead has the least place among its equals once those are ordered
    w = Window.partitionBy(key).orderBy(F.col("__at"), F.col("__side"), F.col("__place")).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn(out, F.first("__place", True).over(w)).where("__side = 0").where(F.col(out).isNotNull())
    return found.select(*targets.columns, out)


def by_distance(path: DataFrame, targets: list[int], stride: int, key: str = "ride_id", along: str = "d_mm", place: str = "seq", least: int = 5, most: int | None = None) -> DataFrame:
    """key, target, start, i0, i1: every `stride` along the ride, where the ride is at least 1.1 targets long.

    most: of more starts than that, evenly spaced ones are taken, first and last included.
    """
    total = path.groupBy(key).agg(F.max(along).alias("total"))
    t = total.select(key, "total", F.explode(F.array(*[F.lit(x).cast("long") for x in targets])).alias("target")).where(F.col("total") * 10 >= F.col("target") * 11)
    starts = F.sequence(F.lit(0).cast("long"), F.col("total") - F.col("target"), F.lit(stride).cast("long"))
    t = t.withColumn("starts", starts)
    if most is not None:
        n = F.size("starts")
        pick = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(F.col("starts"), F.floor(i * (n - 1) / F.lit(most - 1)).cast("int")))
        t = t.withColumn("starts", F.when(n > most, pick).otherwise(F.col("starts")))
    t = t.select(key, "target", F.explode("starts").alias("start"))
    a = first_at_or_after(t, path, key, "start", along, place, "i0")
    b = first_at_or_after(a.withColumn("__end", F.col("start") + F.col("target")), path, key, "__end", along, place, "i1")
    return b.where(F.col("i1") - F.col("i0") >= least).select(key, "target", "start", "i0", "i1")


def by_duration(path: DataFrame, targets: list[int], stride: int, key: str = "ride_id", t: str = "seq", least: int = 5) -> DataFrame:
    """key, target, i0, i1 on a one-second clock."""
    total = path.groupBy(key).agg(F.max(t).alias("total"))
    d = total.select(key, "total", F.explode(F.array(*[F.lit(x).cast("long") for x in targets])).alias("target")).where(F.col("total") * 10 >= F.col("target") * 11)
    d = d.select(key, "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - F.col("target"), F.lit(stride).cast("long"))).alias("i0"))
    return d.withColumn("i1", F.col("i0") + F.col("target")).where(F.col("i1") - F.col("i0") >= least)


def snap_to_fixes(outages: DataFrame, fixes: DataFrame, key: str = "ride_id", place: str = "seq") -> DataFrame:
    """Starts move to the first fix at or after them, ends to the first fix after them (one already on a fix moves on)."""
    f = fixes.select(key, place)
    a = first_at_or_after(outages.withColumnRenamed("i0", "__i0"), f.withColumn("__p", F.col(place)), key, "__i0", "__p", place, "i0")
    b = first_at_or_after(a.withColumnRenamed("i1", "__i1").withColumn("__e", F.col("__i1") + 1), f.withColumn("__p", F.col(place)), key, "__e", "__p", place, "i1")
    kept = b.where("i1 > i0").select(key, "target", "i0", "i1")
    w = Window.partitionBy(key, "i0", "i1").orderBy("target")
    return kept.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_distance(outages: DataFrame, path: DataFrame, key: str = "ride_id", along: str = "d_mm", place: str = "seq") -> DataFrame:
    """Adds d0, d1: distance along the ride at both ends."""
    p = path.select(key, F.col(place).alias("__p"), F.col(along).alias("__d"))
    o = outages.join(p.withColumnRenamed("__p", "i0").withColumnRenamed("__d", "d0"), [key, "i0"])
    return o.join(p.withColumnRenamed("__p", "i1").withColumnRenamed("__d", "d1"), [key, "i1"])


def moving_only(outages: DataFrame, path: DataFrame, least_mm_per_s: float, key: str = "ride_id") -> DataFrame:
    """Outages whose mean speed is at least that."""
    o = with_distance(outages, path, key)
    return o.where((F.col("d1") - F.col("d0")) >= F.lit(least_mm_per_s) * (F.col("i1") - F.col("i0"))).select(*outages.columns)


def initial_state(path: DataFrame, key: str = "ride_id", place: str = "seq", x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """key, place, x0, y0, vx, vy (mm/s): velocity over the last five steps once there are more than five, else over one, else 0."""
    w = Window.partitionBy(key).orderBy(place)

    def v(c: str) -> Column:
        return F.when(F.col(place) > 5, (F.col(c) - F.lag(c, 5).over(w)) / F.lit(5.0)).otherwise(F.coalesce((F.col(c) - F.lag(c).over(w)) / F.lit(1.0), F.lit(0.0)))

    return path.select(key, place, F.col(x).alias("x0"), F.col(y).alias("y0"), v(x).alias("vx"), v(y).alias("vy"))
