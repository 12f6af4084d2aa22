"""Queries of the road operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import fold as D
from trackloom.operators import outage as O
from trackloom.operators import roads as W
from trackloom.plans import folds_sql as Q
from trackloom.plans._register import Register
from trackloom.plans.scoring import OUTAGES_SQL, outages
from trackloom.sources.rides import RIDES_SQL, by_ride, rides
from trackloom.sources.shared import materialize

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query

AT_SQL = """lo AS (SELECT g.*, r.d_mm AS t0, r.x_mm AS x0, r.y_mm AS y0 FROM g ASOF LEFT JOIN r ON g.ride_id = r.ride_id AND g.s >= r.d_mm),
hi AS (SELECT lo.*, r.d_mm AS t1, r.x_mm AS x1, r.y_mm AS y1 FROM lo ASOF LEFT JOIN r ON lo.ride_id = r.ride_id AND lo.s <= r.d_mm),
pl AS (SELECT *, CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL THEN x0 WHEN t0 = t1 THEN x0 ELSE x0 + (x1 - x0) * ((s - t0)::DOUBLE / (t1 - t0)) END AS x,
  CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL THEN y0 WHEN t0 = t1 THEN y0 ELSE y0 + (y1 - y0) * ((s - t0)::DOUBLE / (t1 - t0)) END AS y FROM hi)
"""


def road_of(r):
    return r.select("ride_id", F.col("d_mm").alias("s"), F.col("x_mm").alias("x"), F.col("y_mm").alias("y"))


@query("q_road_at", ", g AS (SELECT ride_id, CAST(unnest(generate_series(0, max(d_mm) + 20000, 10000)) AS BIGINT) AS s FROM r GROUP BY ride_id), " + AT_SQL + "SELECT ride_id, s, round(x, 4) AS x, round(y, 4) AS y FROM pl")
def road_at(spark, sf_dir):
    """Places every 10 m along each ride, and 20 m beyond."""
    r = rides(spark, sf_dir)
    places = r.groupBy("ride_id").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("d_mm") + 20000, F.lit(10000).cast("long"))).alias("s"))
    return W.at(places, road_of(r)).select("ride_id", "s", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("q_road_constrained", OUTAGES_SQL + ", od AS (SELECT DISTINCT ride_id, target, i0, i1 FROM o), g AS (SELECT od.ride_id, od.target, od.i0, od.i1, CAST(a.d_mm + a.step_mm * (od.i1 - od.i0) AS BIGINT) AS s FROM od JOIN r a ON a.ride_id = od.ride_id AND a.seq = od.i0), " + AT_SQL + "SELECT pl.ride_id, target, i0, i1, round(sqrt(pow(x - e.x_mm, 2) + pow(y - e.y_mm, 2)) / 1000.0::DOUBLE, 4) AS drift_m FROM pl JOIN r e ON e.ride_id = pl.ride_id AND e.seq = pl.i1")
def road_constrained(spark, sf_dir):
    """Final drift of a ride that keeps the speed it had at the cut and stays on its road."""
    r, o = outages(spark, sf_dir)
    o = o.select("ride_id", "target", "i0", "i1").distinct()
    start = r.select("ride_id", F.col("seq").alias("i0"), F.col("d_mm").alias("d"), F.col("step_mm").alias("v"))
    end = r.select("ride_id", F.col("seq").alias("i1"), F.col("x_mm").alias("tx"), F.col("y_mm").alias("ty"))
    p = o.join(start, ["ride_id", "i0"]).join(end, ["ride_id", "i1"]).withColumn("s", F.col("d") + F.col("v") * (F.col("i1") - F.col("i0")))
    places = W.at(p.select("ride_id", "s").distinct(), road_of(r))
    found = p.join(places, ["ride_id", "s"])
    return found.select("ride_id", "target", "i0", "i1", F.round(F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)) / 1000.0, 4).alias("drift_m"))


@query("q_road_extended", "SELECT ride_id, count(*) + 20 AS n, min(d_mm)::DOUBLE - 20000 AS lo, max(d_mm)::DOUBLE + 20000 AS hi FROM r GROUP BY ride_id")
def road_extended(spark, sf_dir):
    """Each road with 20 m straight runs at both ends, in steps of 2 m."""
    e = W.extended(road_of(rides(spark, sf_dir)), 20000.0, 2000.0)
    return e.groupBy("ride_id").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))


@query("q_curvature", """, a AS (SELECT ride_id, seq, sum(x_mm) OVER w / count(*) OVER w AS x, sum(y_mm) OVER w / count(*) OVER w AS y FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT *, coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w, 0) AS vx, coalesce((lead(y) OVER w - lag(y) OVER w) / 2, lead(y) OVER w - y, y - lag(y) OVER w, 0) AS vy FROM a WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
c AS (SELECT *, coalesce((lead(vx) OVER w - lag(vx) OVER w) / 2, lead(vx) OVER w - vx, vx - lag(vx) OVER w, 0) AS ax, coalesce((lead(vy) OVER w - lag(vy) OVER w) / 2, lead(vy) OVER w - vy, vy - lag(vy) OVER w, 0) AS ay FROM b WINDOW w AS (PARTITION BY ride_id ORDER BY seq))
SELECT ride_id, seq, round(CASE WHEN vx * vx + vy * vy > 0 THEN (vx * ay - vy * ax) / pow(vx * vx + vy * vy, 1.5) END, 6) AS curvature FROM c""")
def curvature(spark, sf_dir):
    c = W.curvature(rides(spark, sf_dir), "ride_id", "seq", "x_mm", "y_mm")
    return c.select("ride_id", "seq", F.round("curvature", 6).alias("curvature"))


@query("q_heading_mismatch", """, tr AS (SELECT ride_id, seq, d_mm AS s1, head_deg AS h1, d_mm - 40000 AS s0 FROM r WHERE d_mm >= 40000),
a AS (SELECT tr.*, r.head_deg AS h0 FROM tr ASOF LEFT JOIN r ON tr.ride_id = r.ride_id AND tr.s0 >= r.d_mm),
b AS (SELECT a.*, s1 + sh + 30000 AS r1, s1 + sh - 10000 AS r0 FROM a, (SELECT unnest(generate_series(-50000, 50000, 5000))::BIGINT AS sh)),
c AS (SELECT b.*, r.head_deg AS g1 FROM b ASOF LEFT JOIN r ON b.ride_id = r.ride_id AND b.r1 >= r.d_mm),
d AS (SELECT c.*, r.head_deg AS g0 FROM c ASOF LEFT JOIN r ON c.ride_id = r.ride_id AND c.r0 >= r.d_mm)
SELECT ride_id, seq, CAST(min(abs((h1 - h0) - (g1 - g0))) AS BIGINT) AS mismatch FROM d GROUP BY ride_id, seq""")
def heading_mismatch(spark, sf_dir):
    """A ride against itself thirty metres ahead, with 21 shifts of up to 50 m."""
    r = rides(spark, sf_dir).select("ride_id", "seq", "d_mm", "head_deg")
    ahead = r.withColumn("d_mm", F.col("d_mm") - 30000)
    return W.heading_mismatch(r, ahead, 40000, list(range(-50000, 50001, 5000)))


@query("q_heading_change", "SELECT ride_id, CAST(sum(k - 50) FILTER (WHERE d_mm > 50000 AND d_mm <= 150000) AS BIGINT) AS change_deg, CAST(sum(abs(k - 50)) FILTER (WHERE d_mm > 50000 AND d_mm <= 150000) AS BIGINT) AS turned_deg FROM r GROUP BY ride_id")
def heading_change(spark, sf_dir):
    """Net and total heading change between two distances."""
    r = rides(spark, sf_dir)
    within = F.when((F.col("d_mm") > 50000) & (F.col("d_mm") <= 150000), F.col("k") - 50)
    return r.groupBy("ride_id").agg(F.sum(within).alias("change_deg"), F.sum(F.abs(within)).alias("turned_deg"))


@query("q_heading_between", """, g AS (SELECT ride_id, i, CAST(greatest(least(50000 + i * 5000 + o, last), 0) AS BIGINT) AS s, o FROM (SELECT ride_id, max(d_mm) AS last FROM r GROUP BY ride_id), (SELECT unnest(range(20)) AS i), (SELECT unnest([-5000, 5000]) AS o)), """ + AT_SQL + """,
h AS (SELECT a.ride_id, a.i, degrees(atan2(b.y - a.y, b.x - a.x)) AS h FROM pl a JOIN pl b ON a.ride_id = b.ride_id AND a.i = b.i AND a.o < b.o WHERE a.x <> b.x OR a.y <> b.y),
d AS (SELECT ride_id, h - lag(h) OVER (PARTITION BY ride_id ORDER BY i) AS d FROM h)
SELECT ride_id, round(sum(d - 360 * floor((d + 180) / 360)), 4) AS change_deg, count(*) AS steps FROM d WHERE d IS NOT NULL GROUP BY ride_id""")
def heading_between(spark, sf_dir):
    """The heading change of every road from 50 m to 145 m along, at steps of five metres, each heading from the points five metres before and beyond."""
    r = rides(spark, sf_dir)
    places = r.groupBy("ride_id").agg(F.max("d_mm").alias("last")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).withColumn("at", 50000 + F.col("i") * 5000)
    return W.heading_change(places.select("ride_id", "i", "at", "last"), road_of(r), 5000)


@query("q_line_breaks", """, b AS (SELECT ride_id, seq, d_mm, CAST(sum(CASE WHEN step_mm > 10000 OR (NOT gnss_ok AND coalesce(lag_ok, true)) THEN 1 ELSE 0 END) OVER (PARTITION BY ride_id ORDER BY seq) AS BIGINT) AS line FROM (SELECT *, lag(gnss_ok) OVER (PARTITION BY ride_id ORDER BY seq) AS lag_ok FROM r))
SELECT ride_id, line, count(*) AS n, max(d_mm) - min(d_mm) AS length_mm FROM b GROUP BY ride_id, line""")
def line_breaks(spark, sf_dir):
    """The drawn track: a new line after a jump and where an outage begins."""
    r = rides(spark, sf_dir)
    breaks = (F.col("step_mm") > 10000) | (~F.col("gnss_ok") & F.coalesce(F.lag("gnss_ok").over(by_ride()), F.lit(True)))
    return W.segments_by_breaks(r, breaks).groupBy("ride_id", "line").agg(F.count(F.lit(1)).alias("n"), (F.max("d_mm") - F.min("d_mm")).alias("length_mm"))


@query("q_localise_turns", """, t AS (SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY seq) AS i, d_mm AS s, (k - 50)::DOUBLE AS a FROM r WHERE abs(k - 50) > 30),
g AS (SELECT ride_id, i, s AS s1, a AS a1, lead(s) OVER w AS s2, lead(a) OVER w AS a2, lead(s, 2) OVER w AS s3, lead(a, 2) OVER w AS a3, lead(s, 3) OVER w AS s4, lead(a, 3) OVER w AS a4 FROM t WINDOW w AS (PARTITION BY ride_id ORDER BY i)),
p AS (SELECT x.ride_id, x.i AS first, y.ride_id AS road, y.i AS place, round((pow(y.a1 - x.a1, 2) + pow(y.a2 - x.a2, 2) + pow(y.a3 - x.a3, 2) + pow(y.a4 - x.a4, 2)) / 2025.0::DOUBLE
 + (pow((y.s2 - y.s1) - (x.s2 - x.s1), 2) + pow((y.s3 - y.s2) - (x.s3 - x.s2), 2) + pow((y.s4 - y.s3) - (x.s4 - x.s3), 2)) / 1600000000.0::DOUBLE, 6) AS cost
 FROM g x JOIN g y ON x.ride_id <> y.ride_id AND x.a4 IS NOT NULL AND y.a4 IS NOT NULL AND sign(x.a1) = sign(y.a1) AND sign(x.a2) = sign(y.a2) AND sign(x.a3) = sign(y.a3) AND sign(x.a4) = sign(y.a4)
 WHERE abs(y.a1 - x.a1) <= 45 AND abs(y.a2 - x.a2) <= 45 AND abs(y.a3 - x.a3) <= 45 AND abs(y.a4 - x.a4) <= 45)
SELECT ride_id, first, arg_min(road, (cost, road, place)) AS road, arg_min(place, (cost, road, place)) AS place, min(cost) AS cost FROM p GROUP BY ride_id, first""")
def localise_turns(spark, sf_dir):
    """Runs of four sharp turns of every ride, found among the turns of all others."""
    r = rides(spark, sf_dir).where("abs(k - 50) > 30")
    t = r.select("ride_id", F.row_number().over(by_ride()).cast("long").alias("i"), F.col("d_mm").alias("s"), (F.col("k") - 50).cast("double").alias("angle"))
    return W.localise(t, t.withColumnRenamed("ride_id", "road"), 4, lambda d: materialize(d, "turns"), own=False)


@query("q_diverse_destinations", Q.DIVERSE, ctes=False)
def diverse_destinations(spark, sf_dir):
    """The first three points of a ride, by k descending, at least 60 m apart."""
    class Chosen:
        def __init__(self):
            self.kept = []

    def step(f, row):
        xy = (row["x_mm"] / 1000, row["y_mm"] / 1000)
        if len(f.kept) < 3 and all((xy[0] - a) ** 2 + (xy[1] - b) ** 2 >= 3600 for a, b in f.kept):
            f.kept.append(xy)
            return {"seq": row["seq"], "rank": len(f.kept)}
        return None

    r = rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm", (-F.col("k")).alias("order"))
    return D.fold(r, "ride_id", ["order", "seq"], Chosen, step, "ride_id long, seq long, rank int")


@query("q_median_outage", OUTAGES_SQL + ", od AS (SELECT DISTINCT ride_id, target, i0, i1 FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY i1 - i0, ride_id, i0) AS k, count(*) OVER (PARTITION BY target) AS m FROM od) SELECT target, ride_id, i0, i1 FROM n WHERE k = m // 2 + 1")
def median_outage(spark, sf_dir):
    """The outage of median duration for each target: ranked within groups that are split by the target first."""
    from pyspark.sql import Window

    o = outages(spark, sf_dir)[1].select("ride_id", "target", "i0", "i1").distinct()
    w = Window.partitionBy("target")
    n = o.withColumn("k", F.row_number().over(w.orderBy(F.col("i1") - F.col("i0"), "ride_id", "i0"))).withColumn("m", F.count(F.lit(1)).over(w))
    return n.where("k = floor(m / 2) + 1").select("target", "ride_id", "i0", "i1")


@query("q_closing_error", "SELECT ride_id, CAST(pow(arg_max(x_mm, seq) - arg_min(x_mm, seq), 2) + pow(arg_max(y_mm, seq) - arg_min(y_mm, seq), 2) AS BIGINT) AS closing_d2, max(d_mm) AS travelled_mm FROM r GROUP BY ride_id")
def closing_error(spark, sf_dir):
    d = lambda c: F.pow(F.max_by(c, "seq") - F.min_by(c, "seq"), 2)
    return rides(spark, sf_dir).groupBy("ride_id").agg((d("x_mm") + d("y_mm")).cast("long").alias("closing_d2"), F.max("d_mm").alias("travelled_mm"))


@query("q_fraction_blackout", """, n AS (SELECT ride_id, count(*) AS n FROM r GROUP BY ride_id)
SELECT ride_id, count(*) FILTER (WHERE seq * 10 >= n * 2 AND seq * 10 < n * 8) AS denied_rows, CAST(max(d_mm) FILTER (WHERE seq * 10 >= n * 2 AND seq * 10 < n * 8) - min(d_mm) FILTER (WHERE seq * 10 >= n * 2 AND seq * 10 < n * 8) AS BIGINT) AS denied_mm FROM r JOIN n USING (ride_id) GROUP BY ride_id""")
def fraction_blackout(spark, sf_dir):
    """Satellites gone from 20 to 80 per cent of the rows."""
    r = rides(spark, sf_dir)
    d = r.join(r.groupBy("ride_id").agg(F.count(F.lit(1)).alias("n")), "ride_id").withColumn("gone", (F.col("seq") * 10 >= F.col("n") * 2) & (F.col("seq") * 10 < F.col("n") * 8))
    inside = F.when(F.col("gone"), F.col("d_mm"))
    return d.groupBy("ride_id").agg(F.count_if("gone").alias("denied_rows"), (F.max(inside) - F.min(inside)).alias("denied_mm"))
