"""Spatial joins on a grid: nearest segment, radius search, crossings. Every join is an equi-join on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import segment_offset


def cell(v: Column, size: int) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def neighbour_cells(df: DataFrame, x: str, y: str, size: int) -> DataFrame:
    """A row for each of the nine cells around a point: cx, cy."""
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return df.withColumn("__o", offsets).withColumn("cx", cell(F.col(x), size) + F.col("__o.i")).withColumn("cy", cell(F.col(y), size) + F.col("__o.j")).drop("__o")


def within_radius(a: DataFrame, b: DataFrame, radius: int, ax: str = "x", ay: str = "y", bx: str = "x", by: str = "y") -> DataFrame:
    """Pairs of a and b at most `radius` apart, with d2; the side a is copied into nine cells. Columns must differ but for the join."""
    left = neighbour_cells(a, ax, ay, radius)
    right = b.withColumn("cx", cell(F.col(bx), radius)).withColumn("cy", cell(F.col(by), radius))
    d2 = (F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by))
    return left.join(right, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("cx", "cy")


def segments(points: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Consecutive points of a way: key, seg, ax, ay, bx, by."""
    w = Window.partitionBy(key).orderBy(order)
    s = points.select(F.col(key), F.col(order).alias("seg"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.lead(x).over(w).alias("bx"), F.lead(y).over(w).alias("by"))
    return s.where("bx is not null")


def nearest_segment(points: DataFrame, segs: DataFrame, radius: int, id_cols: list[str], x: str, y: str, write, but: str | None = None, steps: int = 4) -> DataFrame:
    """Of each point the nearest segment not further than radius: ids, way, seg, u, d2. Ties go to the least way and seg.

    A segment is posted in every cell its box, grown by the radius, touches; a point looks in its own cell only. The radius is
    doubled `steps` - 1 times up to the one given, and only points that have found nothing go on: where there are many segments the
    first cells, small ones, do, so candidates grow with the points and not with their square. but: a column of points
    that names a way that doesn't count. write: cuts lineage once a step (a written table in the shared folder).
    """
    u, d2, _ = segment_offset(F.col(x), F.col(y), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    best = F.min(F.struct(F.round("d2").alias("r"), "way", "seg", "u", "d2")).alias("b")
    left, found = points, None
    for k in range(steps):
        r = max(radius // 2 ** (steps - 1 - k), 1)
        span = lambda a, b, r=r: F.sequence(cell(F.least(a, b) - r, r), cell(F.greatest(a, b) + r, r))
        posted = segs.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
        pairs = left.withColumn("cx", cell(F.col(x), r)).withColumn("cy", cell(F.col(y), r)).join(posted, ["cx", "cy"])
        pairs = pairs.where(F.col(but) != F.col("way")) if but else pairs
        near = pairs.withColumn("u", u).withColumn("d2", d2).where(F.col("d2") <= float(r) * r)
        now = write(near.groupBy(*id_cols).agg(best).select(*id_cols, "b.way", "b.seg", "b.u", "b.d2"))
        found = now if found is None else found.unionByName(now)
        left = left.join(now, id_cols, "left_anti")
    return found


def crossings(track: DataFrame, marks: DataFrame, radius: int, gap: int, key: str = "ride_id", t: str = "seq") -> DataFrame:
    """Every pass of a ride within `radius` of a mark, split where it is away for more than `gap`: key, mark_id, pass, t, d2, n.

    t is when it came nearest (the earliest of equal ones). track(x, y), marks(mark_id, mx, my) in whole millimetres.
    """
    near = within_radius(track, marks, radius, "x_mm", "y_mm", "mx", "my")
    w = Window.partitionBy(key, "mark_id").orderBy(t)
    new = F.when(F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)), 1).otherwise(0)
    s = near.withColumn("__new", new).withColumn("pass", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "mark_id", "pass").agg(F.min_by(t, F.struct("d2", t)).alias("closest_t"), F.min("d2").alias("d2"), F.count(F.lit(1)).alias("n"))


def clusters(points: DataFrame, size: int, id_col: str = "event_id", x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """Grid clusters with their centroid: the order-free counterpart of clustering in order of arrival."""
    return points.groupBy(cell(F.col(x), size).alias("cx"), cell(F.col(y), size).alias("cy"))
