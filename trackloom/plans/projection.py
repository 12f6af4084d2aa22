"""Queries of projections on routes, of binding to a road, and of roads made from several passes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geo as G
from trackloom.operators import consensus as C
from trackloom.operators import project as J
from trackloom.operators import spatial as P
from trackloom.operators.nearest import coverage
from trackloom.operators.series import ordered, padded_mean, rolling
from trackloom.plans._register import Register
from trackloom.plans.roads import AT_SQL, road_of
from trackloom.sources import sinks as K
from trackloom.sources.rides import RIDES_SQL, rides
from trackloom.sources.shared import materialize

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query

#: Points beside their road, its segments, and every point on every segment of its road.
BESIDE_SQL = """, pt AS (SELECT ride_id, seq, d_mm AS d, gnss_ok, x_mm + (k - 50) * 40 AS px, y_mm - (k % 7) * 300 AS py FROM r),
sg AS (SELECT * FROM (SELECT ride_id, seq AS seg, d_mm AS s0, x_mm AS ax, y_mm AS ay, lead(d_mm) OVER w AS s1, lead(x_mm) OVER w AS bx, lead(y_mm) OVER w AS by_ FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq)) WHERE bx IS NOT NULL AND (ax <> bx OR ay <> by_))
"""
MEASURE_SQL = """, pu AS (SELECT *, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay))::DOUBLE / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0), 1) AS u, sqrt(((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))::DOUBLE) AS len FROM pr),
ms AS (SELECT *, s0 + u * (s1 - s0) AS s, sqrt(pow(ax + u * (bx - ax) - px, 2) + pow(ay + u * (by_ - ay) - py, 2)) AS off, (bx - ax) / len AS tx, (by_ - ay) / len AS ty FROM pu)
"""


def beside(spark, sf_dir):
    """Points some metres beside their road, and the segments of all roads."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "d_mm", "x_mm", "y_mm", "dx_mm", "dy_mm", "k", "gnss_ok", "hit"), "rides")
    points = r.select("ride_id", "seq", F.col("d_mm").alias("d"), "gnss_ok", (F.col("x_mm") + (F.col("k") - 50) * 40).alias("px"), (F.col("y_mm") - (F.col("k") % 7) * 300).alias("py"))
    return r, points, J.legs(r)


@query("q_segment_candidates", BESIDE_SQL + ", la AS (SELECT ride_id, max(seq) AS seq FROM r WHERE gnss_ok GROUP BY ride_id), pr AS (SELECT * FROM pt JOIN la USING (ride_id, seq) JOIN sg USING (ride_id))" + MEASURE_SQL + "SELECT ride_id, seg, round(off, 3) AS off, round(s, 3) AS s, round(tx, 6) AS tx, round(ty, 6) AS ty FROM ms")
def segment_candidates(spark, sf_dir):
    """The last fix of every ride against every segment of its road."""
    r, points, segs = beside(spark, sf_dir)
    last = r.where("gnss_ok").groupBy("ride_id").agg(F.max("seq").alias("seq"))
    c = J.candidates(points.join(last, ["ride_id", "seq"]), segs, "px", "py")
    return c.select("ride_id", "seg", F.round("off", 3).alias("off"), F.round("s", 3).alias("s"), F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))


@query("q_project_near", BESIDE_SQL + ", pr AS (SELECT * FROM pt JOIN sg USING (ride_id) WHERE s1 >= d - 60000 AND s0 <= d + 250000)" + MEASURE_SQL + "SELECT ride_id, seq, round(arg_min(s, (off, seg)), 2) AS s, round(min(off), 2) AS off FROM ms GROUP BY ride_id, seq")
def project_near(spark, sf_dir):
    """Every point on its road, from 60 m behind to 250 m ahead of where it should be."""
    _, points, segs = beside(spark, sf_dir)
    p = J.project_near(points, segs, ["ride_id", "seq"], "d", "px", "py")
    return p.select("ride_id", "seq", F.round("s", 2).alias("s"), F.round("off", 2).alias("off"))


@query("q_project_sequence")
def project_sequence(spark, sf_dir):
    """Every point within 40 m along of the place before it."""
    _, points, segs = beside(spark, sf_dir)
    p = J.follow_road(points, segs, "d", "px", "py")
    return p.select("ride_id", "seq", F.round("s", 2).alias("s"), F.round("off", 2).alias("off"))


SQL["q_project_sequence"] = (
    "WITH RECURSIVE "
    + RIDES_SQL
    + BESIDE_SQL
    + ", pr AS (SELECT * FROM pt JOIN sg USING (ride_id) WHERE s0 - 140000 <= d)"
    + MEASURE_SQL
    + """, mz AS MATERIALIZED (SELECT ride_id, seq, seg, s, off FROM ms),
f(ride_id, seq, s, off) AS (
  SELECT ride_id, seq, arg_min(s, (off, seg)), min(off) FROM mz WHERE seq = 0 GROUP BY ride_id, seq
  UNION ALL SELECT m.ride_id, m.seq, arg_min(m.s, (m.off, m.seg)), min(m.off) FROM f JOIN mz m ON m.ride_id = f.ride_id AND m.seq = f.seq + 1 AND abs(m.s - f.s) <= 40000 GROUP BY m.ride_id, m.seq)
SELECT ride_id, seq, round(s, 2) AS s, round(off, 2) AS off FROM f"""
)


@query("q_road_start", BESIDE_SQL + """, lf AS (SELECT ride_id AS id, seq, x_mm AS px, y_mm AS py, dx_mm AS hx, dy_mm AS hy FROM (SELECT *, max(seq) FILTER (WHERE gnss_ok) OVER (PARTITION BY ride_id) AS m FROM r) WHERE seq = m),
ln AS (SELECT ride_id, max(d_mm) AS length FROM r GROUP BY ride_id),
pr AS (SELECT lf.id, lf.px, lf.py, lf.hx, lf.hy, sg.*, ln.length FROM lf JOIN sg ON lf.id <> sg.ride_id AND px BETWEEN least(ax, bx) - 150000 AND greatest(ax, bx) + 150000 AND py BETWEEN least(ay, by_) - 150000 AND greatest(ay, by_) + 150000 JOIN ln ON ln.ride_id = sg.ride_id)""" + MEASURE_SQL + """, nr AS (SELECT * FROM (SELECT *, min(off) OVER (PARTITION BY id, ride_id) AS least_off FROM ms WHERE off <= 150000) WHERE off <= least_off + 15000),
dr AS (SELECT *, CASE WHEN tx * hx + ty * hy < 0 THEN s ELSE length - s END AS ahead, CASE WHEN tx * hx + ty * hy < 0 THEN -1 ELSE 1 END AS direction FROM nr),
ls AS (SELECT id, list({'way': ride_id, 's': s, 'off': off, 'direction': direction, 'ahead': ahead} ORDER BY ride_id, seg) AS l FROM dr GROUP BY id),
be AS (SELECT id, list_reduce(l, lambda b, c: CASE WHEN c.off < b.off - 15000 OR (c.off <= b.off + 15000 AND c.ahead > b.ahead) THEN c ELSE b END) AS b FROM ls)
SELECT id AS ride_id, b.way AS way, round(b.s, 2) AS s, round(b.off, 2) AS off, b.direction AS direction FROM be""")
def road_start(spark, sf_dir):
    """Which other ride's road a ride is on at its last fix, where on it and which way."""
    r, _, segs = beside(spark, sf_dir)
    last = F.max_by(F.struct("x_mm", "y_mm", "dx_mm", "dy_mm"), "seq").alias("l")
    points = r.where("gnss_ok").groupBy(F.col("ride_id").alias("own")).agg(last).select("own", "l.*")
    lengths = r.groupBy(F.col("ride_id").alias("way")).agg(F.max("d_mm").alias("length"))
    pairs = J.bind(points, segs.withColumnRenamed("ride_id", "way"), lengths, "own", "x_mm", "y_mm", "dx_mm", "dy_mm", but_own=True)
    return pairs.select(F.col("own").alias("ride_id"), "way", F.round("s", 2).alias("s"), F.round("off", 2).alias("off"), "direction")


@query("q_route_ahead", ", g AS (SELECT ride_id, 100000::BIGINT AS s FROM r GROUP BY ride_id), " + AT_SQL + "SELECT ride_id, s::DOUBLE AS s, round(x, 4) AS x, round(y, 4) AS y FROM pl UNION ALL SELECT ride_id, d_mm::DOUBLE, x_mm::DOUBLE, y_mm::DOUBLE FROM r WHERE d_mm > 100000")
def route_ahead(spark, sf_dir):
    """What is left of every road 100 m along."""
    a = J.ahead(road_of(rides(spark, sf_dir)), F.lit(100000).cast("long"))
    return a.select("ride_id", "s", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("q_corridor_clip", """, ga AS (SELECT ride_id, max(x_mm) FILTER (WHERE seq = CASE WHEN ride_id % 2 = 0 THEN 5 ELSE 30 END) + 3000 AS ax, max(y_mm) FILTER (WHERE seq = CASE WHEN ride_id % 2 = 0 THEN 5 ELSE 30 END) AS ay,
 max(x_mm) FILTER (WHERE seq = CASE WHEN ride_id % 2 = 0 THEN 30 ELSE 5 END) AS bx, max(y_mm) FILTER (WHERE seq = CASE WHEN ride_id % 2 = 0 THEN 30 ELSE 5 END) + 9000 AS by_ FROM r GROUP BY ride_id),
nr AS (SELECT ride_id, arg_min(seq, ((x_mm - ax) * (x_mm - ax) + (y_mm - ay) * (y_mm - ay), seq)) AS a, min((x_mm - ax) * (x_mm - ax) + (y_mm - ay) * (y_mm - ay)) AS da, arg_min(seq, ((x_mm - bx) * (x_mm - bx) + (y_mm - by_) * (y_mm - by_), seq)) AS b, min((x_mm - bx) * (x_mm - bx) + (y_mm - by_) * (y_mm - by_)) AS db FROM r JOIN ga USING (ride_id) GROUP BY ride_id)
SELECT r.ride_id, abs(seq - a) AS n, x_mm, y_mm FROM r JOIN nr USING (ride_id) WHERE da <= 3600000000 AND db <= 3600000000 AND seq BETWEEN least(a, b) AND greatest(a, b)""")
def corridor_clip(spark, sf_dir):
    """The part of a ride between two gates; rides of odd number pass them the other way round."""
    r = rides(spark, sf_dir)
    even = F.col("ride_id") % 2 == 0
    place = lambda c, a, b, more: (F.max(F.when(F.col("seq") == F.when(even, a).otherwise(b), F.col(c))) + more)
    gates = r.groupBy("ride_id").agg(place("x_mm", 5, 30, 3000).alias("ax"), place("y_mm", 5, 30, 0).alias("ay"), place("x_mm", 30, 5, 0).alias("bx"), place("y_mm", 30, 5, 9000).alias("by"))
    return J.clip(r.select("ride_id", "seq", "x_mm", "y_mm"), gates, 60000.0).select("ride_id", "n", "x_mm", "y_mm")


SNAP_SQL = """, sg AS (SELECT * FROM (SELECT ride_id AS way, seq AS seg, x_mm AS ax, y_mm AS ay, lead(x_mm) OVER w AS bx, lead(y_mm) OVER w AS by_ FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq)) WHERE bx IS NOT NULL),
c AS (SELECT r.ride_id, r.seq, r.x_mm AS px, r.y_mm AS py, sg.*, (bx - ax)::DOUBLE AS dx, (by_ - ay)::DOUBLE AS dy, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS l2 FROM r JOIN sg ON ride_id <> way AND x_mm BETWEEN least(ax, bx) - 20000 AND greatest(ax, bx) + 20000 AND y_mm BETWEEN least(ay, by_) - 20000 AND greatest(ay, by_) + 20000),
u AS (SELECT *, least(greatest(CASE WHEN l2 > 0 THEN ((px - ax) * dx + (py - ay) * dy) / l2 ELSE 0 END, 0), 1) AS u FROM c),
d AS (SELECT *, ax + u * dx AS qx, ay + u * dy AS qy, (ax + u * dx - px) * (ax + u * dx - px) + (ay + u * dy - py) * (ay + u * dy - py) AS d2 FROM u),
b AS (SELECT ride_id, seq, arg_min({'x': qx, 'y': qy, 'd2': d2}, (round(d2), way, seg)) AS b FROM d WHERE d2 <= 20000.0::DOUBLE * 20000 GROUP BY ride_id, seq),
sn AS (SELECT ride_id, seq, b.x AS x, b.y AS y, sqrt(b.d2) AS off FROM b)
"""


def snapped(spark, sf_dir):
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm"), "rides")
    segs = P.segments(r, "ride_id", "seq", "x_mm", "y_mm").withColumnRenamed("ride_id", "way")
    points = r.select(F.col("ride_id").alias("own"), "seq", F.col("x_mm").alias("px"), F.col("y_mm").alias("py"))
    b = P.nearest_segment(points, segs, 20000, ["own", "seq"], "px", "py", lambda d: materialize(d, "nearest"), but="own").join(segs, ["way", "seg"])
    return b.select(F.col("own").alias("ride_id"), "seq", (F.col("ax") + F.col("u") * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + F.col("u") * (F.col("by") - F.col("ay"))).alias("y"), F.sqrt("d2").alias("off"))


@query("q_snapped_track", SNAP_SQL + "SELECT ride_id, seq, round(x, 1) AS x, round(y, 1) AS y, round(off, 1) AS off FROM sn")
def snapped_track(spark, sf_dir):
    """Every point moved to the nearest road of other rides."""
    return snapped(spark, sf_dir).select("ride_id", "seq", *[F.round(c, 1).alias(c) for c in ("x", "y", "off")])


def smooth_sql(table: str, key: str, order: str, out: str, before: int, after: int) -> str:
    """A table with the padded means of x and y, as in operators.series.padded_mean."""
    n = before + after + 1

    def mean(c: str) -> str:
        return f"(sum({c}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) + first_value({c}) OVER w * greatest({before} + 1 - row_number() OVER w, 0) + last_value({c}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * greatest(row_number() OVER w + {after} - count(*) OVER (PARTITION BY {key}), 0)) / {n}"

    return f"{out} AS (SELECT {key}, {order}, {mean('x')} AS x, {mean('y')} AS y FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY {order}))"


@query("q_road_from_map", SNAP_SQL + ", " + smooth_sql("sn", "ride_id", "seq", "sm", 3, 2) + " SELECT ride_id, seq, round(x, 1) AS x, round(y, 1) AS y FROM sm")
def road_from_map(spark, sf_dir):
    """A centreline from a track: snapped to the map, then a mean of six along, padded at its ends."""
    s = snapped(spark, sf_dir)
    w = ordered("ride_id", "seq")
    whole = Window.partitionBy("ride_id")
    return s.select("ride_id", "seq", *[F.round(padded_mean(F.col(c), w, whole, 3, 2), 1).alias(c) for c in "xy"])


@query("q_city_snap", SNAP_SQL + "SELECT ride_id, count(*) AS snapped, round(avg(off), 1) AS mean_off, round(max(off), 1) AS worst_off FROM sn GROUP BY ride_id")
def city_snap(spark, sf_dir):
    """The same in degrees: points and roads as latitude and longitude, longitude scaled by the cosine of the area's latitude."""
    lat0, lon0, unit = 15.36, 75.12, 1e-3 / G.R_EQUATOR * 180.0 / 3.141592653589793  # a millimetre in degrees
    r = rides(spark, sf_dir)
    lat, lon = G.from_enu(F.col("x_mm") / 1000, F.col("y_mm") / 1000, lat0, lon0)
    ll = r.select("ride_id", "seq", lat.alias("lat"), lon.alias("lon"))
    scaled = ll.select("ride_id", "seq", F.round((F.col("lon") - lon0) * F.cos(F.radians(F.lit(lat0))) / unit).cast("long").alias("x"), F.round((F.col("lat") - lat0) / unit).cast("long").alias("y"))
    scaled = materialize(scaled, "scaled")
    segs = P.segments(scaled, "ride_id", "seq", "x", "y").withColumnRenamed("ride_id", "way")
    points = scaled.select(F.col("ride_id").alias("own"), "seq", F.col("x").alias("px"), F.col("y").alias("py"))
    b = P.nearest_segment(points, segs, 20000, ["own", "seq"], "px", "py", lambda d: materialize(d, "nearest"), but="own")
    off = F.sqrt("d2")
    return b.groupBy(F.col("own").alias("ride_id")).agg(F.count(F.lit(1)).alias("snapped"), F.round(F.avg(off), 1).alias("mean_off"), F.round(F.max(off), 1).alias("worst_off"))


PASSES_SQL = """, tr AS (SELECT ride_id, track, seq AS j, x_mm + ((k * (track + 1) * 37) % 21 - 10) * 100 AS x, y_mm + ((k * (track + 2) * 53) % 21 - 10) * 100 AS y FROM r, (SELECT unnest(range(5)) AS track))
"""


def passes(spark, sf_dir):
    """Five passes over every ride's road, each up to a metre off in its own way."""
    r = rides(spark, sf_dir).withColumn("track", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    off = lambda a, b: ((F.col("k") * (F.col("track") + a) * b) % 21 - 10) * 100
    return materialize(r.select("ride_id", "track", F.col("seq").alias("j"), (F.col("x_mm") + off(1, 37)).alias("x"), (F.col("y_mm") + off(2, 53)).alias("y")), "passes")


TYPICAL_SQL = PASSES_SQL + """, nn AS (SELECT a.ride_id, a.track AS of_, a.j AS i, b.track, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE) AS d FROM tr a JOIN tr b ON a.ride_id = b.ride_id GROUP BY ALL),
sc AS (SELECT ride_id, of_, round(avg(d), 6) AS mean FROM (SELECT ride_id, of_, track, avg(d) AS d FROM nn GROUP BY ALL) GROUP BY ride_id, of_),
ty AS (SELECT ride_id, arg_min(of_, (mean, of_)) AS track FROM sc GROUP BY ride_id)
"""


@query("q_typical_track", TYPICAL_SQL + "SELECT * FROM ty")
def typical_track(spark, sf_dir):
    return C.most_typical(passes(spark, sf_dir), 20000, lambda d: materialize(d, "nearest"))


@query("q_consensus_track", TYPICAL_SQL + """, st AS (SELECT tr.* FROM tr JOIN ty USING (ride_id, track)),
ne AS (SELECT st.ride_id, st.j AS i, b.track, arg_min({'x': b.x, 'y': b.y}, ((st.x - b.x) * (st.x - b.x) + (st.y - b.y) * (st.y - b.y), b.j)) AS p FROM st JOIN tr b ON st.ride_id = b.ride_id GROUP BY ALL)
SELECT ride_id, i, quantile_cont(p.x, 0.5) AS x, quantile_cont(p.y, 0.5) AS y, count(*) AS n FROM ne GROUP BY ride_id, i""")
def consensus_track(spark, sf_dir):
    """The median of five passes, along the most typical one."""
    return C.consensus(passes(spark, sf_dir), 20000, lambda d: materialize(d, "nearest"))


def fused_sql(rounds: int) -> str:
    sql, line = PASSES_SQL + ", sz AS (SELECT ride_id, max(j) AS last FROM tr GROUP BY ride_id), l0 AS (SELECT ride_id, j AS i, x::DOUBLE AS x, y::DOUBLE AS y FROM tr WHERE track = 0)", "l0"
    for n in range(1, rounds + 1):
        sql += f""", n{n} AS (SELECT s.ride_id, s.i, b.track, arg_min({{'x': b.x, 'y': b.y, 'j': b.j}}, ((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y), b.j)) AS p FROM {line} s JOIN tr b ON s.ride_id = b.ride_id AND (s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y) <= 400000000.0::DOUBLE GROUP BY ALL),
m{n} AS (SELECT n.ride_id, i, avg(p.x) AS x, avg(p.y) AS y FROM n{n} n JOIN sz USING (ride_id) WHERE p.j > 0 AND p.j < last GROUP BY n.ride_id, i),
{smooth_sql(f"m{n}", "ride_id", "i", f"l{n}", 2, 2)}"""
        line = f"l{n}"
    return sql


@query("q_fused_track", fused_sql(4) + " SELECT ride_id, i, round(x, 2) AS x, round(y, 2) AS y FROM l4")
def fused_track(spark, sf_dir):
    """Five passes averaged into one line, in four rounds."""
    f = C.fuse(passes(spark, sf_dir), 20000, lambda d: materialize(d, "fused"))
    return f.select("ride_id", "i", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("q_map_score", PASSES_SQL + """, mp AS (SELECT * FROM tr WHERE track = 1 AND j % 3 < 2), ne AS (SELECT r.ride_id, r.seq, sqrt(min((r.x_mm - x) * (r.x_mm - x) + (r.y_mm - y) * (r.y_mm - y))::DOUBLE) AS d, arg_min(j, ((r.x_mm - x) * (r.x_mm - x) + (r.y_mm - y) * (r.y_mm - y), j)) AS j FROM r JOIN mp ON r.ride_id = mp.ride_id GROUP BY r.ride_id, r.seq),
xt AS (SELECT ride_id, quantile_cont(d, 0.5) AS m, quantile_cont(d, 0.9) AS p, max(d) AS worst, arg_min(j, seq) AS j0, arg_max(j, seq) AS j1 FROM ne GROUP BY ride_id),
la AS (SELECT ride_id, j, sum(l) OVER (PARTITION BY ride_id ORDER BY j) AS s FROM (SELECT ride_id, j, coalesce(sqrt((pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2))::DOUBLE), 0) AS l FROM mp WINDOW w AS (PARTITION BY ride_id ORDER BY j))),
lb AS (SELECT ride_id, coalesce(sum(l), 0) AS b FROM (SELECT ride_id, sqrt((pow(x_mm - lag(x_mm) OVER w, 2) + pow(y_mm - lag(y_mm) OVER w, 2))::DOUBLE) AS l FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq)) GROUP BY ride_id)
SELECT xt.ride_id, round(m, 3) AS xtrack_med, round(p, 3) AS xtrack_p90, round(worst, 3) AS xtrack_worst, round(CASE WHEN b > 0 THEN 100.0::DOUBLE * (abs(q1.s - q0.s) - b) / b END, 4) AS len_err FROM xt JOIN lb USING (ride_id) JOIN la q0 ON q0.ride_id = xt.ride_id AND q0.j = j0 JOIN la q1 ON q1.ride_id = xt.ride_id AND q1.j = j1""")
def map_score(spark, sf_dir):
    """The second pass without every third point as a map, against the ride itself."""
    line = passes(spark, sf_dir).where("track = 1 and j % 3 < 2").select("ride_id", F.col("j").alias("i"), "x", "y")
    truth = rides(spark, sf_dir).select("ride_id", F.col("seq").alias("i"), F.col("x_mm").alias("x"), F.col("y_mm").alias("y"))
    s = C.map_score(line, truth, 20000, lambda d: materialize(d, "nearest"))
    return s.select("ride_id", *[F.round(c, 3).alias(c) for c in ("xtrack_med", "xtrack_p90", "xtrack_worst")], F.round("len_err", 4).alias("len_err"))


@query("q_restationed_consensus", TYPICAL_SQL + """, s0 AS (SELECT tr.ride_id, tr.j AS i, tr.x, tr.y FROM tr JOIN ty USING (ride_id, track)),
""" + ",\n".join(f"""n{k} AS (SELECT st.ride_id, st.i, b.track, arg_min({{'x': b.x, 'y': b.y}}, ((st.x - b.x) * (st.x - b.x) + (st.y - b.y) * (st.y - b.y), b.j)) AS p FROM s{k} st JOIN tr b ON st.ride_id = b.ride_id GROUP BY ALL),
m{k} AS (SELECT ride_id, i, quantile_cont(p.x, 0.5)::DOUBLE AS x, quantile_cont(p.y, 0.5)::DOUBLE AS y FROM n{k} GROUP BY ride_id, i),
l{k} AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS l FROM m{k} WINDOW w AS (PARTITION BY ride_id ORDER BY i)),
c{k} AS (SELECT ride_id, s, arg_min(x, i) AS x, arg_min(y, i) AS y FROM (SELECT *, sum(l) OVER (PARTITION BY ride_id ORDER BY i) AS s FROM l{k}) WHERE l > 0 OR s = 0 GROUP BY ride_id, s),
g{k} AS (SELECT ride_id, i, i * 2000.0::DOUBLE AS s FROM (SELECT ride_id, unnest(range(greatest(ceil(max(s) / 2000)::BIGINT, 1))) AS i FROM c{k} GROUP BY ride_id)),
a{k} AS (SELECT g.*, c.s AS t0, c.x AS x0, c.y AS y0 FROM g{k} g ASOF LEFT JOIN c{k} c ON g.ride_id = c.ride_id AND g.s >= c.s),
b{k} AS (SELECT a.*, c.s AS t1, c.x AS x1, c.y AS y1 FROM a{k} a ASOF LEFT JOIN c{k} c ON a.ride_id = c.ride_id AND a.s <= c.s),
s{k + 1} AS (SELECT ride_id, i, CASE WHEN t1 IS NULL OR t0 = t1 THEN x0 ELSE x0 + (x1 - x0) * ((s - t0) / (t1 - t0)) END AS x, CASE WHEN t1 IS NULL OR t0 = t1 THEN y0 ELSE y0 + (y1 - y0) * ((s - t0) / (t1 - t0)) END AS y FROM b{k})""" for k in (0, 1)) + """
SELECT ride_id, count(*) AS stations, round(sum(x) / 1e6, 3) AS sum_x, round(sum(y) / 1e6, 3) AS sum_y FROM s2 GROUP BY ride_id""")
def restationed_consensus(spark, sf_dir):
    """The median of five passes, stationed anew every two metres on its own result."""
    line = C.consensus(passes(spark, sf_dir), 20000, lambda d: materialize(d, "nearest"), step=2000.0)
    return line.groupBy("ride_id").agg(F.count(F.lit(1)).alias("stations"), F.round(F.sum("x") / 1e6, 3).alias("sum_x"), F.round(F.sum("y") / 1e6, 3).alias("sum_y"))


@query("q_consensus_draws", PASSES_SQL + """, dw AS (SELECT a AS draw, unnest(list_distinct([a % 5, (a * 2 + 1) % 5, (a * 3 + 2) % 5])) AS track FROM (SELECT unnest(range(20)) AS a)),
ne AS (SELECT r.ride_id, r.seq, b.track, arg_min({'x': b.x, 'y': b.y}, ((r.x_mm - b.x) * (r.x_mm - b.x) + (r.y_mm - b.y) * (r.y_mm - b.y), b.j)) AS p FROM r JOIN tr b ON r.ride_id = b.ride_id GROUP BY ALL),
md AS (SELECT draw, ride_id, seq, quantile_cont(p.x, 0.5) AS x, quantile_cont(p.y, 0.5) AS y, avg(p.x) AS mx, avg(p.y) AS my FROM ne JOIN dw USING (track) GROUP BY ALL)
SELECT draw, count(*) AS stations, round(avg(sqrt(pow(x - x_mm, 2) + pow(y - y_mm, 2))), 3) AS median_err, round(avg(sqrt(pow(mx - x_mm, 2) + pow(my - y_mm, 2))), 3) AS mean_err FROM md JOIN r USING (ride_id, seq) GROUP BY draw""")
def consensus_draws(spark, sf_dir):
    """Twenty fixed draws of up to three passes: how far their median and their mean are from the ride."""
    r = rides(spark, sf_dir)
    stations = r.select("ride_id", F.col("seq").alias("i"), F.col("x_mm").alias("x"), F.col("y_mm").alias("y"))
    near = C.nearest_of_tracks(stations, passes(spark, sf_dir), 20000, lambda d: materialize(d, "nearest"))
    draws = spark.range(20).withColumnRenamed("id", "draw").select("draw", F.explode(F.array_distinct(F.array(F.col("draw") % 5, (F.col("draw") * 2 + 1) % 5, (F.col("draw") * 3 + 2) % 5))).alias("track"))
    m = near.join(F.broadcast(draws), "track").groupBy("draw", "ride_id", "i").agg(F.percentile("x", 0.5).alias("px"), F.percentile("y", 0.5).alias("py"), F.avg("x").alias("mx"), F.avg("y").alias("my"))  # sixty rows
    e = lambda a: F.hypot(F.col(f"{a}x") - F.col("x"), F.col(f"{a}y") - F.col("y"))
    return m.join(stations, ["ride_id", "i"]).groupBy("draw").agg(F.count(F.lit(1)).alias("stations"), F.round(F.avg(e("p")), 3).alias("median_err"), F.round(F.avg(e("m")), 3).alias("mean_err"))


@query("q_landmark_arcs", BESIDE_SQL + ", pr AS (SELECT pt.*, sg.* EXCLUDE (ride_id) FROM pt JOIN (SELECT ride_id, seq FROM r WHERE hit) h USING (ride_id, seq) JOIN sg ON sg.ride_id = pt.ride_id)" + MEASURE_SQL + ", ar AS (SELECT ride_id, seq, arg_min(s, (off, seg)) AS s, min(off) AS off FROM ms GROUP BY ride_id, seq) SELECT ride_id, seq, row_number() OVER (PARTITION BY ride_id ORDER BY s, seq) AS place, round(s, 2) AS s, round(off, 2) AS off FROM ar")
def landmark_arcs(spark, sf_dir):
    """Where along its road every surveyed landmark lies, in that order."""
    r, points, segs = beside(spark, sf_dir)
    marks = points.join(r.where("hit").select("ride_id", "seq"), ["ride_id", "seq"], "left_semi")
    best = J.candidates(marks, segs, "px", "py").groupBy("ride_id", "seq").agg(F.min(F.struct("off", "seg", "s")).alias("b")).select("ride_id", "seq", F.col("b.s").alias("s"), F.col("b.off").alias("off"))
    place = F.row_number().over(Window.partitionBy("ride_id").orderBy("s", "seq")).cast("long")
    return best.select("ride_id", "seq", place.alias("place"), F.round("s", 2).alias("s"), F.round("off", 2).alias("off"))


@query("q_survey_centroids", """, an AS (SELECT ride_id, seq AS noted FROM r WHERE hit), nr AS (SELECT an.ride_id, noted, x_mm, y_mm, 1.0::DOUBLE / ((k + 5) * (k + 5)) AS w FROM an JOIN r ON r.ride_id = an.ride_id AND r.seq BETWEEN noted - 3 AND noted + 3 WHERE gnss_ok)
SELECT ride_id, noted, count(*) AS n, round(sum(w * x_mm) / sum(w), 3) AS x, round(sum(w * y_mm) / sum(w), 3) AS y FROM nr GROUP BY ride_id, noted""")
def survey_centroids(spark, sf_dir):
    """Survey notes as places: the fixes of three seconds around each, weighed by the inverse square of their accuracy (k + 5)."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm", "k", "gnss_ok", "hit"), "rides")
    notes = r.where("hit").select("ride_id", F.col("seq").alias("noted"), F.explode(F.sequence(F.col("seq") - 3, F.col("seq") + 3)).alias("seq"))
    return J.weighted_centroids(notes.join(r.where("gnss_ok"), ["ride_id", "seq"]), ["ride_id", "noted"], F.lit(1.0) / ((F.col("k") + 5) * (F.col("k") + 5)))


@query("q_survey_places", """, an AS (SELECT ride_id, seq AS noted FROM r WHERE hit AND k < 5), nr AS (SELECT an.ride_id, noted, x_mm, y_mm, 1.0::DOUBLE / ((k + 5) * (k + 5)) AS w FROM an JOIN r ON r.ride_id = an.ride_id AND r.seq BETWEEN noted - 3 AND noted + 3 WHERE gnss_ok),
ns AS (SELECT ride_id, noted, count(*) AS n, round(sum(w * x_mm) / sum(w), 3) AS x, round(sum(w * y_mm) / sum(w), 3) AS y FROM nr GROUP BY ride_id, noted),
sl AS (SELECT *, quantile_cont(step_mm, 0.5) OVER (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) < 3000 AS slow FROM r),
il AS (SELECT *, sum(n) OVER (PARTITION BY ride_id ORDER BY seq) AS stop FROM (SELECT *, CASE WHEN lag(slow) OVER (PARTITION BY ride_id ORDER BY seq) IS NOT DISTINCT FROM slow THEN 0 ELSE 1 END AS n FROM sl)),
dw AS (SELECT ride_id, min(seq) AS noted, count(*) AS n, round(avg(x_mm), 3) AS x, round(avg(y_mm), 3) AS y FROM il WHERE slow GROUP BY ride_id, stop HAVING max(seq) - min(seq) >= 4 AND sqrt(var_pop(x_mm) + var_pop(y_mm)) < 6000)
SELECT * FROM ns UNION ALL SELECT * FROM dw WHERE ride_id NOT IN (SELECT ride_id FROM ns)""")
def survey_places(spark, sf_dir):
    """Survey notes as places; rides without a note give the stops of five seconds and more within six metres."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm", "step_mm", "k", "gnss_ok", "hit"), "rides")
    notes = r.where("hit and k < 5").select("ride_id", F.col("seq").alias("noted"), F.explode(F.sequence(F.col("seq") - 3, F.col("seq") + 3)).alias("seq"))
    noted = materialize(J.weighted_centroids(notes.join(r.where("gnss_ok"), ["ride_id", "seq"]), ["ride_id", "noted"], F.lit(1.0) / ((F.col("k") + 5) * (F.col("k") + 5))), "notes")
    slow = rolling(F.col("step_mm"), ordered("ride_id", "seq"), 2, 2, "median") < 3000
    return J.survey_places(noted, J.dwell_centroids(r, slow, 4, 6000))


SCENARIOS_SQL = PASSES_SQL + """, ln AS (SELECT ride_id, max(d_mm) AS total FROM r GROUP BY ride_id),
al AS (SELECT tr.ride_id, tr.track, tr.j, tr.x, tr.y, -1 AS fault FROM tr UNION ALL
 SELECT ride_id, track, j, CAST(round(x - p * sin(h)) AS BIGINT), CAST(round(y + p * cos(h)) AS BIGINT), fault FROM (SELECT tr.ride_id, tr.track, tr.j, tr.x, tr.y, fault, radians(head_deg::DOUBLE) AS h, round(40000 * greatest(least((d_mm - a) / 40000.0::DOUBLE, (a + 250000 - d_mm) / 40000.0::DOUBLE, 1), 0)) AS p
 FROM (SELECT tr.*, r.d_mm, r.head_deg, fault, (0.25::DOUBLE + 0.1::DOUBLE * fault) * total AS a FROM tr JOIN r ON r.ride_id = tr.ride_id AND r.seq = tr.j JOIN ln ON ln.ride_id = tr.ride_id, (SELECT unnest(range(4)) AS fault)) tr)),
ne AS (SELECT r.ride_id, r.seq, b.track, b.fault, arg_min({'x': b.x, 'y': b.y}, ((r.x_mm - b.x) * (r.x_mm - b.x) + (r.y_mm - b.y) * (r.y_mm - b.y), b.j)) AS p FROM r JOIN al b ON r.ride_id = b.ride_id GROUP BY ALL),
dr AS (SELECT d, d % 5 AS p0, (d + 1 + d // 5 % 2) % 5 AS p1, (d + 3 + d // 5 % 2) % 5 AS p2, d % 4 AS f FROM (SELECT unnest(range(20)) AS d)),
sc AS (SELECT d, '1 contributor' AS scenario, unnest([{'t': p0, 'f': -1}]) AS m, 'median' AS how FROM dr UNION ALL SELECT d, '3 contributors', unnest([{'t': p0, 'f': -1}, {'t': p1, 'f': -1}, {'t': p2, 'f': -1}]), 'median' FROM dr
 UNION ALL SELECT d, 'faulty alone', unnest([{'t': p2, 'f': f}]), 'median' FROM dr UNION ALL SELECT d, '3 with faulty, mean', unnest([{'t': p0, 'f': -1}, {'t': p1, 'f': -1}, {'t': p2, 'f': f}]), 'mean' FROM dr
 UNION ALL SELECT d, '3 with faulty, median', unnest([{'t': p0, 'f': -1}, {'t': p1, 'f': -1}, {'t': p2, 'f': f}]), 'median' FROM dr UNION ALL SELECT 0, 'all, median', unnest([{'t': 0, 'f': -1}, {'t': 1, 'f': -1}, {'t': 2, 'f': -1}, {'t': 3, 'f': -1}, {'t': 4, 'f': -1}]), 'median'),
cs AS (SELECT d, scenario, ride_id, seq, CASE how WHEN 'mean' THEN avg(p.x) ELSE quantile_cont(p.x, 0.5) END AS x, CASE how WHEN 'mean' THEN avg(p.y) ELSE quantile_cont(p.y, 0.5) END AS y FROM ne JOIN sc ON sc.m.t = ne.track AND sc.m.f = ne.fault GROUP BY d, scenario, how, ride_id, seq),
er AS (SELECT d, scenario, ride_id, quantile_cont(sqrt(pow(x - x_mm, 2) + pow(y - y_mm, 2)), 0.5) AS med, quantile_cont(sqrt(pow(x - x_mm, 2) + pow(y - y_mm, 2)), 0.95) AS p95 FROM cs JOIN r USING (ride_id, seq) GROUP BY d, scenario, ride_id)
SELECT scenario, count(*) AS maps, round(quantile_cont(med, 0.5), 3) AS shape_median, round(quantile_cont(p95, 0.5), 3) AS shape_p95, round(quantile_cont(p95, 0.9), 3) AS worst_tenth FROM er GROUP BY scenario"""


@query("q_fault_scenarios", SCENARIOS_SQL)
def fault_scenarios(spark, sf_dir):
    """Maps of one or three passes, drawn twenty times by a table, with and without one that was pushed 40 m aside over 250 m, against the ride itself."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm", "d_mm", "head_deg"), "rides")
    good = passes(spark, sf_dir)
    at = good.join(r.select("ride_id", F.col("seq").alias("j"), "d_mm", "head_deg"), ["ride_id", "j"]).join(r.groupBy("ride_id").agg(F.max("d_mm").alias("total")), "ride_id")
    at = at.withColumn("fault", F.explode(F.array(*map(F.lit, range(4))))).withColumn("a", (F.lit(0.25) + F.lit(0.1) * F.col("fault")) * F.col("total")).withColumn("h", F.radians(F.col("head_deg").cast("double")))
    push = F.round(40000 * F.greatest(F.least((F.col("d_mm") - F.col("a")) / 40000.0, (F.col("a") + 250000 - F.col("d_mm")) / 40000.0, F.lit(1.0)), F.lit(0.0)))
    bad = at.select("ride_id", "track", "j", F.round(F.col("x") - push * F.sin("h")).cast("long").alias("x"), F.round(F.col("y") + push * F.cos("h")).cast("long").alias("y"), "fault")
    both = good.withColumn("fault", F.lit(-1)).unionByName(bad).withColumn("track", F.col("fault") * 10 + F.col("track")).drop("fault")
    near = materialize(C.nearest_of_tracks(r.select("ride_id", F.col("seq").alias("i"), F.col("x_mm").alias("x"), F.col("y_mm").alias("y")), both, 20000, lambda d: materialize(d, "nearest")).drop("d"), "scenario-points")
    rows = []
    for d in range(20):
        p0, p1, p2, f = d % 5, (d + 1 + d // 5 % 2) % 5, (d + 3 + d // 5 % 2) % 5, d % 4
        plan = {"1 contributor": ([p0 - 10], "median"), "3 contributors": ([p0 - 10, p1 - 10, p2 - 10], "median"), "faulty alone": ([p2 + 10 * f], "median"), "3 with faulty, mean": ([p0 - 10, p1 - 10, p2 + 10 * f], "mean"), "3 with faulty, median": ([p0 - 10, p1 - 10, p2 + 10 * f], "median")} | ({"all, median": ([t - 10 for t in range(5)], "median")} if d == 0 else {})
        rows += [(d, name, t, how) for name, (tracks, how) in plan.items() for t in tracks]
    draws = F.broadcast(spark.createDataFrame(rows, "d int, scenario string, track int, how string"))  # 225 rows
    pick = lambda c: F.when(F.first("how") == "mean", F.avg(c)).otherwise(F.percentile(c, 0.5)).alias(f"m{c}")
    made = near.join(draws, "track").groupBy("d", "scenario", "ride_id", F.col("i").alias("seq")).agg(pick("x"), pick("y"))
    off = made.join(r, ["ride_id", "seq"]).withColumn("e", F.sqrt(F.pow(F.col("mx") - F.col("x_mm"), 2) + F.pow(F.col("my") - F.col("y_mm"), 2)))
    each = off.groupBy("d", "scenario", "ride_id").agg(F.percentile("e", 0.5).alias("med"), F.percentile("e", 0.95).alias("p95"))
    return each.groupBy("scenario").agg(F.count(F.lit(1)).alias("maps"), F.round(F.percentile("med", 0.5), 3).alias("shape_median"), F.round(F.percentile("p95", 0.5), 3).alias("shape_p95"), F.round(F.percentile("p95", 0.9), 3).alias("worst_tenth"))


COVERAGE_SQL = """, mp AS (SELECT x_mm AS x, y_mm AS y FROM r WHERE ride_id % 3 <> 0 AND seq % 4 = 0), bx AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM mp),
ne AS (SELECT ride_id, seq, sqrt(min((x_mm - x) * (x_mm - x) + (y_mm - y) * (y_mm - y))::DOUBLE) / 10 AS d FROM r, mp GROUP BY ride_id, seq),
g AS (SELECT ride_id, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.9) AS p90, max(d) AS worst, count(*) AS n FROM ne GROUP BY ride_id),
m AS (SELECT ride_id, least(min(x_mm) - any_value(x0), any_value(x1) - max(x_mm), min(y_mm) - any_value(y0), any_value(y1) - max(y_mm)) / 10.0::DOUBLE AS margin FROM r, bx GROUP BY ride_id)
"""
GATE_SQL = "CASE WHEN n < 10 THEN 'SKIP' WHEN p90 > 150 OR worst > 300 OR margin < 0 THEN 'FAIL' WHEN p90 > 80 OR worst > 150 OR margin < 200 THEN 'WARN' ELSE 'OK' END"


@query("q_map_coverage", COVERAGE_SQL + "SELECT ride_id, round(p50, 3) AS p50, round(p90, 3) AS p90, round(worst, 3) AS worst, margin, " + GATE_SQL + " AS gate FROM g JOIN m USING (ride_id)")
def map_coverage(spark, sf_dir):
    """Whether a map, of two rides in three, covers each ride: by the distances of its points from the map's and by the map's box; centimetres stand for metres."""
    g = covered(materialize(rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm"), "rides"))
    return g.select("ride_id", F.round("p50", 3).alias("p50"), F.round("p90", 3).alias("p90"), F.round("worst", 3).alias("worst"), "margin", "gate")


def covered(r):
    road = r.where("ride_id % 3 <> 0 and seq % 4 = 0").select(F.col("x_mm").alias("tx"), F.col("y_mm").alias("ty"), F.lit(0).alias("target"))
    return coverage(r.select("ride_id", "seq", F.col("x_mm").alias("x"), F.col("y_mm").alias("y")), road, lambda d: materialize(d, "nearest"), 20000, unit=10.0)


@query("q_route_export", COVERAGE_SQL + ", n AS (SELECT ride_id AS name, max(d_mm) AS length_mm, count(*) AS n_points, 'learned' AS source FROM r WHERE hit GROUP BY ride_id HAVING ride_id IN (SELECT ride_id FROM (SELECT ride_id, " + GATE_SQL + """ AS gate FROM g JOIN m USING (ride_id)) WHERE gate IN ('OK', 'WARN'))),
o AS (SELECT ride_id AS name, max(d_mm) AS length_mm, count(*) AS n_points, 'shipped' AS source FROM r GROUP BY ride_id)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE name NOT IN (SELECT name FROM n)""")
def route_export(spark, sf_dir):
    """Learned routes replace shipped ones of their name where the map covers their ride."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm", "d_mm", "hit"), "rides")
    routes = lambda d, source: d.groupBy(F.col("ride_id").alias("name")).agg(F.max("d_mm").alias("length_mm"), F.count(F.lit(1)).alias("n_points")).withColumn("source", F.lit(source))
    return K.export_routes(routes(r, "shipped"), routes(r.where("hit"), "learned"), covered(r).select(F.col("ride_id").alias("name"), "gate"))
