"""Roads as one-dimensional lines: places by distance along, turns, and what a track says about the route it is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.series import bracket, gradient, ordered, rolling


def at(places: DataFrame, road: DataFrame, key: str = "ride_id", s: str = "s", x: str = "x", y: str = "y", with_heading: bool = False) -> DataFrame:
    """places(key, s) with x, y on the road(key, s, x, y) at that distance, held at its ends. with_heading: and heading (radians), null at its own points and ends."""
    b = bracket(places, road.withColumn("__p", F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))), key, s, "__p")
    share = F.when(F.col("t1") == F.col("t0"), F.lit(0.0)).otherwise((F.col(s) - F.col("t0")) / (F.col("t1") - F.col("t0")))

    def along(c: str) -> Column:
        lo, hi = F.col(f"v0.{c}"), F.col(f"v1.{c}")
        return F.when(F.col("t0").isNull(), hi).when(F.col("t1").isNull(), lo).otherwise(lo + (hi - lo) * share)

    heading = F.when(F.col("t1") != F.col("t0"), F.atan2(F.col("v1.y") - F.col("v0.y"), F.col("v1.x") - F.col("v0.x")))
    return b.select(key, s, along("x").alias(x), along("y").alias(y), *([heading.alias("heading")] if with_heading else []))


def extended(road: DataFrame, length: float, step: float, key: str = "ride_id", s: str = "s", x: str = "x", y: str = "y") -> DataFrame:
    """The road and straight runs of `length` before its start and beyond its end, in the direction of its outer segments.

    Without them, a place beyond an end would be held there and its error be flattered.
    """
    w = ordered(key, s)
    legs = road.withColumn("__ds", F.lead(s).over(w) - F.col(s)).withColumn("__dx", F.lead(x).over(w) - F.col(x)).withColumn("__dy", F.lead(y).over(w) - F.col(y)).where("__dx * __dx + __dy * __dy > 0 and __ds > 0")
    leg = F.struct(s, x, y, (F.col("__dx") / F.col("__ds")).alias("ux"), (F.col("__dy") / F.col("__ds")).alias("uy"))
    ends = legs.groupBy(key).agg(F.min_by(leg, s).alias("a"), F.max_by(leg, s).alias("b"))
    last = road.groupBy(key).agg(F.max_by(F.struct(s, x, y), s).alias("z"))
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.lit(int(length / step))), lambda i: i * F.lit(float(step)))).alias("d")
    e = ends.join(last, key).select(key, "a", "b", "z", steps)
    before = e.select(key, (F.col(f"a.{s}") - F.col("d")).alias(s), (F.col(f"a.{x}") - F.col("a.ux") * F.col("d")).alias(x), (F.col(f"a.{y}") - F.col("a.uy") * F.col("d")).alias(y))
    after = e.select(key, (F.col(f"z.{s}") + F.col("d")).alias(s), (F.col(f"z.{x}") + F.col("b.ux") * F.col("d")).alias(x), (F.col(f"z.{y}") + F.col("b.uy") * F.col("d")).alias(y))
    core = road.select(key, F.col(s).cast("double").alias(s), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return core.unionByName(before).unionByName(after)


def curvature(track: DataFrame, key: str, order: str, x: str, y: str, smooth: int = 5) -> DataFrame:
    """Signed curvature of a smoothed track, from first and second central differences; null where it stands still."""
    w, half = ordered(key, order), smooth // 2
    t = track.withColumn("__x", rolling(F.col(x), w, half, half, "mean")).withColumn("__y", rolling(F.col(y), w, half, half, "mean"))
    t = t.withColumn("__vx", gradient(F.col("__x"), w)).withColumn("__vy", gradient(F.col("__y"), w))
    t = t.withColumn("__ax", gradient(F.col("__vx"), w)).withColumn("__ay", gradient(F.col("__vy"), w))
    speed2 = F.col("__vx") * F.col("__vx") + F.col("__vy") * F.col("__vy")
    k = F.when(speed2 > 0, (F.col("__vx") * F.col("__ay") - F.col("__vy") * F.col("__ax")) / F.pow(speed2, 1.5))
    return t.withColumn("curvature", k).drop("__x", "__y", "__vx", "__vy", "__ax", "__ay")


def heading_change(places: DataFrame, road: DataFrame, half: int, key: str = "ride_id") -> DataFrame:
    """key, change_deg, steps: the wrapped steps of the road's heading from one place(key, i, at, last: the road's length) to the next, summed.

    The heading at a place is that from the point `half` before to the point `half` beyond, held at the ends; places without one are left out.
    """
    asked = places.select(key, "i", F.explode(F.array(F.lit(-half), F.lit(half))).alias("o"), "at", "last").withColumn("s", F.greatest(F.least(F.col("at") + F.col("o"), F.col("last")), F.lit(0)))
    found = asked.join(at(asked.select(key, "s").distinct(), road, key), [key, "s"]).groupBy(key, "i").agg(*[F.max(F.when(F.col("o") == o, F.col(c))).alias(f"{c}{n}") for n, o in enumerate((-half, half)) for c in "xy"])
    h = found.where("x0 <> x1 or y0 <> y1").withColumn("h", F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))))
    step = F.col("h") - F.lag("h").over(Window.partitionBy(key).orderBy("i"))
    d = h.select(key, step.alias("d")).where("d is not null")
    return d.groupBy(key).agg(F.round(F.sum(F.col("d") - 360 * F.floor((F.col("d") + 180) / 360)), 4).alias("change_deg"), F.count(F.lit(1)).alias("steps"))


def heading_mismatch(track: DataFrame, route: DataFrame, window: int, shifts: list[int], key: str = "ride_id", t: str = "seq", s: str = "d_mm", heading: str = "head_deg") -> DataFrame:
    """Of each row, by how much its turn over the last `window` of travel differs from the route's there, at the best shift.

    track and route: key, (t), s, heading. Route headings are those of the last row at or before a distance.
    """
    rows = track.select(key, t, F.col(s).alias("s1"), F.col(heading).alias("h1")).where(F.col("s1") >= window)

    def latest(at: DataFrame, line: DataFrame, where: str, out: str) -> DataFrame:
        r = line.select(F.col(key), F.col(s).alias("__at"), F.lit(0).alias("__side"), F.col(heading).alias("__h"))
        both = at.withColumn("__at", F.col(where)).withColumn("__side", F.lit(1)).unionByName(r, allowMissingColumns=True)
        w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(out, F.last("__h", True).over(w)).where("__side = 1").drop("__at", "__side", "__h")

    rows = latest(rows.withColumn("s0", F.col("s1") - window), track, "s0", "h0")
    rows = rows.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("r1", F.col("s1") + F.col("shift")).withColumn("r0", F.col("r1") - window)
    rows = latest(latest(rows, route, "r1", "g1"), route, "r0", "g0")
    off = F.abs((F.col("h1") - F.col("h0")) - (F.col("g1") - F.col("g0")))
    return rows.groupBy(key, t).agg(F.min(off).alias("mismatch"))


def segments_by_breaks(track: DataFrame, breaks: Column, key: str = "ride_id", t: str = "seq") -> DataFrame:
    """track and line: a new line begins where breaks is true."""
    w = ordered(key, t)
    return track.withColumn("line", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def localise(turns: DataFrame, road_turns: DataFrame, n: int, write, angle: float = 45.0, gap: float = 40000.0, key: str = "ride_id", steps: int = 4, own: bool = True) -> DataFrame:
    """Where on a road a sequence of n turns fits best: key, first (turn of the ride), road, place (on the road), cost.

    turns and road_turns: key / road, i, s, angle. Signs must agree and no angle may be off by more than `angle`; the cost is the sum of
    squared differences of angles and of the gaps between turns, in units of `angle` and `gap`. A fit that costs no more than
    reach^2 has no gap off by more than reach * gap, so sequences meet in an equi-join on their signs and on cells of that
    width of their first two gaps. The reach begins at 1/16 and is doubled for those that found nothing within it; what is
    left after `steps` doublings meets all sequences of the same signs. own: whether a ride may be found on the road of its own name.
    """
    def grams(d: DataFrame, of: str, p: str) -> DataFrame:
        w = Window.partitionBy(of).orderBy("i")
        seq = F.collect_list(F.struct("s", "angle")).over(w.rowsBetween(0, n - 1))
        g = d.withColumn("__g", seq).where(F.size("__g") == n)
        gaps = [(F.col("__g")[k]["s"] - F.col("__g")[k - 1]["s"]).alias(f"{p}{k}") for k in (1, min(2, n - 1))][: max(n - 1, 1)]
        return write(g.select(F.col(of), F.col("i").alias(f"{p}i"), F.col("__g").alias(f"{p}g"), F.transform("__g", lambda x: F.signum(x["angle"])).alias("signs"), *gaps))

    left, b, found = grams(turns, key, "a"), grams(road_turns, "road", "b"), None
    both = F.arrays_zip("ag", "bg")
    fits = F.forall(both, lambda z: F.abs(z["bg"]["angle"] - z["ag"]["angle"]) <= angle)
    by_angle = F.aggregate(both, F.lit(0.0), lambda t, z: t + F.pow(z["bg"]["angle"] - z["ag"]["angle"], 2)) / angle**2
    places = F.sequence(F.lit(1), F.lit(n - 1))
    by_gap = F.aggregate(places, F.lit(0.0), lambda t, k: t + F.pow((F.get("bg", k)["s"] - F.get("bg", k - 1)["s"]) - (F.get("ag", k)["s"] - F.get("ag", k - 1)["s"]), 2)) / gap**2
    beside = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for k in range(steps + 1):
        reach = 2.0**k / 16 if k < steps else None
        if reach is None:
            pairs = left.join(b, "signs")
        else:
            cell = lambda c, r=reach: F.floor(F.col(c) / (r * gap))
            asked = left.withColumn("__o", beside).withColumn("c1", cell("a1") + F.col("__o.i")).withColumn("c2", cell("a2") + F.col("__o.j")).drop("__o")
            pairs = asked.join(b.withColumn("c1", cell("b1")).withColumn("c2", cell("b2")), ["signs", "c1", "c2"])
        pairs = pairs if own else pairs.where(F.col(key) != F.col("road"))
        scored = pairs.where(fits).withColumn("cost", F.round(by_angle + by_gap, 6))
        scored = scored if reach is None else scored.where(F.col("cost") <= reach * reach * 0.999)
        now = scored.groupBy(key, "ai").agg(F.min(F.struct("cost", "road", "bi")).alias("m"))
        now = write(now.select(key, F.col("ai").alias("first"), F.col("m.road").alias("road"), F.col("m.bi").alias("place"), F.col("m.cost").alias("cost")))
        found = now if found is None else found.unionByName(now)
        left = left.join(now.select(key, F.col("first").alias("ai")), [key, "ai"], "left_anti")
    return found
