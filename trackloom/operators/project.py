"""Points against routes: candidates on segments, projections within a window of the distance along, binding to a road, routes ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import segment_offset
from trackloom.operators import fold as D
from trackloom.operators.roads import at
from trackloom.operators.series import islands
from trackloom.operators.spatial import cell


def legs(road: DataFrame, key: str = "ride_id", order: str = "seq", s: str = "d_mm", x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """key, seg, s0, s1, ax, ay, bx, by: the segments of roads that have a length."""
    w = Window.partitionBy(key).orderBy(order)
    p = road.select(key, F.col(order).alias("seg"), *[F.col(c).alias(a) for c, a in ((s, "s0"), (x, "ax"), (y, "ay"))], *[F.lead(c).over(w).alias(a) for c, a in ((s, "s1"), (x, "bx"), (y, "by"))])
    return p.where("bx is not null and (ax <> bx or ay <> by)")


def _measured(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Adds off (distance), s (along the road), tx, ty (unit tangent) of a point on a segment."""
    u, d2, length2 = segment_offset(F.col(x), F.col(y), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    pairs = pairs.withColumn("off", F.sqrt(d2)).withColumn("s", F.col("s0") + u * (F.col("s1") - F.col("s0")))
    return pairs.withColumn("tx", (F.col("bx") - F.col("ax")) / F.sqrt(length2)).withColumn("ty", (F.col("by") - F.col("ay")) / F.sqrt(length2))


def candidates(points: DataFrame, segs: DataFrame, x: str, y: str, key: str = "ride_id") -> DataFrame:
    """points(key, ...) with every segment of the road of the same key: seg, off, s, tx, ty. A road is short; points are few."""
    return _measured(points.join(segs, key), x, y).drop("ax", "ay", "bx", "by", "s0", "s1")


def project_near(points: DataFrame, segs: DataFrame, ids: list[str], near: str, x: str, y: str, behind: float = 60000.0, ahead: float = 250000.0, key: str = "ride_id") -> DataFrame:
    """ids, s, off: the nearest place on the road, of the stretch from `behind` before to `ahead` beyond a distance (near).

    So a road that passes a spot twice can't draw a point to the wrong pass. Points and segments meet on cells of the distance along.
    """
    size = int(behind + ahead)
    lo, hi = F.col(near) - F.lit(behind), F.col(near) + F.lit(ahead)
    asked = points.withColumn("__c", F.explode(F.sequence(cell(lo, size), cell(hi, size))))
    # a segment lies in the cell of its start, and in those that it reaches
    posted = segs.withColumn("__c", F.explode(F.sequence(cell(F.col("s0"), size), cell(F.col("s1"), size))))
    pairs = _measured(asked.join(posted, [key, "__c"]).where((F.col("s1") >= lo) & (F.col("s0") <= hi)), x, y)
    best = F.min(F.struct("off", "seg", "s")).alias("b")
    return pairs.groupBy(*ids).agg(best).select(*ids, F.col("b.s").alias("s"), F.col("b.off").alias("off"))


class Follow:
    """Projects a track on its road, each point within `window` along of the place before it; the first one anywhere.

    Rows are segments (kind 0) and points (kind 1), merged by where they are expected; only segments that the window can still
    reach are held.
    """

    def __init__(self, window: float, slack: float):
        self.window, self.slack, self.segs, self.at = window, slack, [], None

    def step(self, row: dict) -> dict | None:
        if row["kind"] == 0:
            self.segs.append(row)
            return None
        best = None
        for g in self.segs:
            dx, dy = g["bx"] - g["ax"], g["by"] - g["ay"]
            u = min(max(((row["x"] - g["ax"]) * dx + (row["y"] - g["ay"]) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
            s = g["s0"] + u * (g["s1"] - g["s0"])
            if self.at is not None and abs(s - self.at) > self.window:
                continue
            off = ((g["ax"] + u * dx - row["x"]) ** 2 + (g["ay"] + u * dy - row["y"]) ** 2) ** 0.5
            if best is None or off < best[0]:
                best = (off, s)
        if best is None:
            return {"seq": row["seq"], "s": self.at, "off": None}
        self.at = best[1]
        self.segs = [g for g in self.segs if g["s1"] >= self.at - self.window - self.slack]
        return {"seq": row["seq"], "s": best[1], "off": best[0]}


def follow_road(points: DataFrame, segs: DataFrame, expected: str, x: str, y: str, window: float = 40000.0, slack: float = 100000.0, key: str = "ride_id", t: str = "seq") -> DataFrame:
    """key, seq, s, off: the places of a track on its road, one after the other; null off where nothing is in the window.

    expected: about how far along a point is; a point may be up to `slack` off that. Segments come to the fold that much earlier.
    """
    double = lambda c, n: F.col(c).cast("double").alias(n)
    a = segs.select(key, F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("seq"), (F.col("s0") - F.lit(slack) - F.lit(window)).cast("double").alias("place"), *[double(c, c) for c in ("s0", "s1", "ax", "ay", "bx", "by")])
    b = points.select(key, F.lit(1).alias("kind"), F.col(t).alias("seq"), double(expected, "place"), double(x, "x"), double(y, "y"))
    rows = a.unionByName(b, allowMissingColumns=True)
    return D.fold(rows, key, ["place", "kind", "seq", "s0"], lambda: Follow(window, 2 * slack), lambda f, row: f.step(row), f"{key} long, seq long, s double, off double")


def bind(points: DataFrame, segs: DataFrame, lengths: DataFrame, id_col: str, x: str, y: str, tx: str, ty: str, most: int = 150000, tie: float = 15000.0, but_own: bool = False) -> DataFrame:
    """id, way, s, off, direction: the road that a ride is on at its last fix, where, and which way along.

    points(id, x, y, tx, ty: direction of travel, null if unknown), segs(way, seg, ...), lengths(way, length). Of a road those
    places count that are no more than `tie` farther than its nearest, which must be within `most`. A place more than `tie`
    nearer wins; one within it wins if it has more road ahead. Roads are compared in the order of their names. but_own: the road
    named like the point doesn't count.
    """
    span = lambda a, b: F.sequence(cell(F.least(a, b) - most, most), cell(F.greatest(a, b) + most, most))
    posted = segs.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    pairs = points.withColumn("cx", cell(F.col(x), most)).withColumn("cy", cell(F.col(y), most)).join(posted, ["cx", "cy"])
    pairs = pairs.where(F.col(id_col) != F.col("way")) if but_own else pairs
    pairs = _measured(pairs.withColumnRenamed(tx, "__hx").withColumnRenamed(ty, "__hy"), x, y).where(F.col("off") <= most)
    least = F.min("off").over(Window.partitionBy(id_col, "way"))
    pairs = pairs.withColumn("__least", least).where(F.col("off") <= F.col("__least") + tie).join(lengths, "way")
    back = F.coalesce(F.col("tx") * F.col("__hx") + F.col("ty") * F.col("__hy") < 0, F.lit(False))
    rows = pairs.withColumn("direction", F.when(back, -1).otherwise(1)).withColumn("ahead", F.when(back, F.col("s")).otherwise(F.col("length") - F.col("s")))

    class Best:
        def __init__(self):
            self.row = None

    def step(f, row):
        b = f.row
        if b is None or row["off"] < b["off"] - tie or (row["off"] <= b["off"] + tie and row["ahead"] > b["ahead"]):
            f.row = row

    def finish(f, key):
        return [{c: f.row[c] for c in ("way", "s", "off", "direction")}]

    return D.fold(rows.select(id_col, "way", "seg", "s", "off", "direction", "ahead"), id_col, ["way", "seg"], Best, step, f"{id_col} long, way long, s double, off double, direction int", finish)


def ahead(road: DataFrame, start: Column, key: str = "ride_id", s: str = "s", x: str = "x", y: str = "y") -> DataFrame:
    """The rest of each road from a distance on, with the place at that distance as its first point. start: by key."""
    heads = at(road.select(key, start.alias(s)).distinct(), road, key, s, x, y)
    rest = road.where(F.col(s) > start).select(key, F.col(s).cast("double").alias(s), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return heads.select(key, F.col(s).cast("double").alias(s), x, y).unionByName(rest)


def clip(track: DataFrame, gates: DataFrame, most: float, key: str = "ride_id", t: str = "seq", x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """The part of each track between the points nearest to two gates(key, ax, ay, bx, by), and n: its order from the first gate to the second.

    Tracks that come no nearer than `most` to either gate go.
    """
    g = track.join(gates, key)
    d2 = lambda a: F.pow(F.col(x) - F.col(f"{a}x"), 2) + F.pow(F.col(y) - F.col(f"{a}y"), 2)
    near = g.groupBy(key).agg(F.min(F.struct(d2("a").alias("d"), t)).alias("a"), F.min(F.struct(d2("b").alias("d"), t)).alias("b")).where((F.col("a.d") <= most * most) & (F.col("b.d") <= most * most))
    near = near.select(key, F.col(f"a.{t}").alias("__a"), F.col(f"b.{t}").alias("__b"))
    cut = track.join(near, key).where(F.col(t).between(F.least("__a", "__b"), F.greatest("__a", "__b")))
    return cut.withColumn("n", F.abs(F.col(t) - F.col("__a"))).drop("__a", "__b")


def weighted_centroids(fixes: DataFrame, keys: list[str], weight: Column, x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """keys, n, x, y: the weighted mean place of each group of fixes, to three digits."""
    f = fixes.withColumn("__w", weight)
    mean = lambda c: F.round(F.sum(F.col("__w") * F.col(c)) / F.sum("__w"), 3)
    return f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), mean(x).alias("x"), mean(y).alias("y"))


def dwell_centroids(track: DataFrame, slow: Column, least: float, most: float, key: str = "ride_id", t: str = "seq", x: str = "x_mm", y: str = "y_mm") -> DataFrame:
    """key, noted, n, x, y, spread: the mean place of every stop, slow rows in a row that last `least` and spread (root mean square) less than `most`."""
    i = islands(track.withColumn("__slow", slow), F.col("__slow"), key, t, "__stop").where("__slow")
    mean = lambda c: F.avg(F.col(c))
    g = i.groupBy(key, "__stop").agg(F.min(t).alias("noted"), F.max(t).alias("__end"), F.count(F.lit(1)).alias("n"), mean(x).alias("x"), mean(y).alias("y"), F.sqrt(F.var_pop(F.col(x)) + F.var_pop(F.col(y))).alias("spread"))
    g = g.where((F.col("__end") - F.col("noted") >= least) & (F.col("spread") < most))
    return g.select(key, "noted", "n", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("spread", 3).alias("spread"))


def survey_places(noted: DataFrame, dwells: DataFrame, key: str = "ride_id") -> DataFrame:
    """Places of a survey's notes(key, noted, n, x, y), and of the stops of those rides that have no note."""
    return noted.select(key, "noted", "n", "x", "y").unionByName(dwells.join(noted.select(key).distinct(), key, "left_anti").select(key, "noted", "n", "x", "y"))
