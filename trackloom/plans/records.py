"""Queries of the readers and writers: tables go out as the files that the readers expect, in the shared folder, and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import score as C
from trackloom.operators import series as S
from trackloom.plans._register import Register
from trackloom.plans.scoring import SCORES_SQL, scores
from trackloom.sources import files as L
from trackloom.sources import sinks as K
from trackloom.sources.rides import RIDES_SQL, rides
from trackloom.sources.shared import materialize, shared_dir

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query


def folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/trackloom-{label}-{uuid.uuid4().hex}"


def as_csv(df, label: str, header: bool = True) -> str:
    path = folder(df.sparkSession, label)
    df.write.csv(path, header=header)
    return path


@query("q_sensor_log", "SELECT ride_id::VARCHAR AS sensor, count(*) AS n, round(sum(dx_mm / 1000.0::DOUBLE), 3) AS x, round(sum(dy_mm / 1000.0::DOUBLE), 3) AS y, round(max(seq) + 0.25::DOUBLE, 6) AS t1 FROM r WHERE hit GROUP BY ride_id")
def sensor_log(spark, sf_dir):
    """Hits of a ride as a sensor's log: time in nanoseconds, z, y, x."""
    r = rides(spark, sf_dir).where("hit")
    log = r.select((F.col("seq") * 1000000000 + 250000000).alias("time"), F.col("seq").cast("double").alias("seconds_elapsed"), F.col("ride_id").cast("double").alias("z"), (F.col("dy_mm") / 1000).alias("y"), (F.col("dx_mm") / 1000).alias("x"))
    d = L.sensor_csv(spark, as_csv(log, "sensor"), "accelerometer")
    return d.groupBy(F.col("z").cast("long").cast("string").alias("sensor")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("y"), 3).alias("y"), F.round(F.max("t"), 6).alias("t1"))


@query("q_location_log", """, a AS (SELECT ride_id, seq, 15 + y_mm / 1e8::DOUBLE AS lat, CASE WHEN gnss_ok THEN 75 + x_mm / 1e8::DOUBLE END AS lon, CASE WHEN k = 7 THEN 0.0::DOUBLE ELSE 15 + y_mm / 1e8::DOUBLE END AS la FROM r)
SELECT CAST(ride_id AS DOUBLE) AS altitude, count(*) AS n, round(min(la), 8) AS lat0, round(max(lon), 8) AS lon1, CAST(max(seq) AS DOUBLE) AS t1 FROM a WHERE lon IS NOT NULL AND abs(la) > 1e-6 GROUP BY ride_id HAVING count(*) >= 40""")
def location_log(spark, sf_dir):
    """Fixes as two layouts of location logs, one without some columns; usable ones of rides with forty or more."""
    r = rides(spark, sf_dir)
    lat, lon = F.when(F.col("k") == 7, 0.0).otherwise(F.lit(15) + F.col("y_mm") / 1e8), F.when(F.col("gnss_ok"), F.lit(75) + F.col("x_mm") / 1e8)
    log = r.select((F.col("seq") * 1000000000).alias("time"), F.col("ride_id").cast("double").alias("altitude"), lon.alias("longitude"), lat.alias("latitude"), F.lit(1.0).alias("speed"))
    a, b = as_csv(log.where("time % 2000000000 = 0"), "location"), as_csv(log.where("time % 2000000000 <> 0").drop("speed"), "location")
    d = L.usable_fixes(L.location_csv(spark, [a, b]), "altitude", 40)
    return d.groupBy("altitude").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("lat"), 8).alias("lat0"), F.round(F.max("lon"), 8).alias("lon1"), F.max("t").alias("t1"))


@query("q_inertial_log", "SELECT ride_id, count(*) AS n, max(seq)::DOUBLE AS t1, round(sum(k / 10.0::DOUBLE), 3) AS ax, round(sum(value), 3) AS gz, round(avg(15 + y_mm / 1e8::DOUBLE), 6) AS lat, true AS complete FROM r GROUP BY ride_id")
def inertial_log(spark, sf_dir):
    """A log with columns of other names and time in milliseconds: columns found by their names, time scaled by its steps."""
    r = rides(spark, sf_dir)
    named = {"Time Since Start (ms)": F.col("seq") * 1000, "Linear Acc X": F.col("k") / 10, "Linear Acc Y": F.lit(0.0), "Linear Acc Z": F.lit(9.8), "Ang Rate X": F.lit(0.0), "Ang Rate Y": F.lit(0.0), "Ang Rate Z": F.col("value"), "GPS Latitude": F.lit(15) + F.col("y_mm") / 1e8, "GPS Longitude": F.lit(75) + F.col("x_mm") / 1e8, "Velocity": F.col("value") / 10, "Gravity X": F.lit(0.0)}
    path = as_csv(r.select("ride_id", *[c.alias(n) for n, c in named.items()]), "inertial")
    raw = spark.read.csv(path, header=True, inferSchema=True)
    found = L.resolve_columns([c for c in raw.columns if c != "ride_id"])
    complete = not L.lacking([c for c in raw.columns if c != "ride_id"])
    d = raw.select("ride_id", *[F.col(f"`{c}`").cast("double").alias(k) for k, c in found.items()])
    d = d.withColumn("t", F.col("t") / L.time_scale(1000.0, "ms" in L.plain_name(found["t"])))
    return d.groupBy(F.col("ride_id").cast("long").alias("ride_id")).agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t1"), F.round(F.sum("ax"), 3).alias("ax"), F.round(F.sum("gz"), 3).alias("gz"), F.round(F.avg("lat"), 6).alias("lat"), F.lit(complete).alias("complete"))


@query("q_ride_grid", """, s AS (SELECT ride_id, kind_, seq + o AS t, v FROM (SELECT ride_id, seq, 'acc' AS kind_, 0.0::DOUBLE AS o, k::DOUBLE AS v FROM r UNION ALL SELECT ride_id, seq, 'gyro', 0.25::DOUBLE, value FROM r WHERE seq > 2)),
e AS (SELECT ride_id, max(a) AS a, min(b) AS b FROM (SELECT ride_id, kind_, min(t) AS a, max(t) AS b FROM s GROUP BY ALL) GROUP BY ride_id HAVING count(*) = 2 AND min(b) > max(a)),
g AS (SELECT ride_id, a + i * 0.5::DOUBLE AS t FROM (SELECT ride_id, a, unnest(range(CAST(ceil((b - a) * 2 - 1e-9) AS BIGINT))) AS i FROM e)),
lo AS (SELECT g.*, q.kind_, s.t AS t0, s.v AS v0 FROM g CROSS JOIN (SELECT unnest(['acc', 'gyro']) AS kind_) q ASOF LEFT JOIN s ON g.ride_id = s.ride_id AND q.kind_ = s.kind_ AND g.t >= s.t),
hi AS (SELECT lo.*, s.t AS t1, s.v AS v1 FROM lo ASOF LEFT JOIN s ON lo.ride_id = s.ride_id AND lo.kind_ = s.kind_ AND lo.t <= s.t),
iv AS (SELECT ride_id, t, kind_, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS v FROM hi)
SELECT ride_id, t, round(max(v) FILTER (WHERE kind_ = 'acc'), 6) AS acc, round(max(v) FILTER (WHERE kind_ = 'gyro'), 6) AS gyro FROM iv GROUP BY ride_id, t""")
def ride_grid(spark, sf_dir):
    """Two sensors of a ride on their common grid of two a second: the time both have, each interpolated."""
    r = rides(spark, sf_dir)
    acc = r.select("ride_id", F.lit("acc").alias("kind"), F.col("seq").cast("double").alias("t"), F.col("k").cast("double").alias("v"))
    gyro = r.where("seq > 2").select("ride_id", F.lit("gyro").alias("kind"), (F.col("seq") + 0.25).alias("t"), F.col("value").alias("v"))
    grid = L.overlap(acc.unionByName(gyro), "t", "ride_id", "kind", 2.0)
    a = S.interpolate(grid, acc, "ride_id", "t", "v").withColumnRenamed("v", "acc")
    b = S.interpolate(grid, gyro, "ride_id", "t", "v").withColumnRenamed("v", "gyro")
    return a.join(b, ["ride_id", "t"]).select("ride_id", "t", F.round("acc", 6).alias("acc"), F.round("gyro", 6).alias("gyro"))


@query("q_sensor_grid", SQL["q_ride_grid"], ctes=False)
def sensor_grid(spark, sf_dir):
    """The same grid from a stream of the sensors' events, sample by sample."""
    from trackloom.operators import fold as D
    from trackloom.operators.features import SensorGrid

    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "k", "value"), "rides")
    acc = r.select("ride_id", F.lit(0).alias("kind"), F.col("seq").cast("double").alias("t"), F.col("k").cast("double").alias("v"))
    gyro = r.where("seq > 2").select("ride_id", F.lit(1).alias("kind"), (F.col("seq") + 0.25).alias("t"), F.col("value").alias("v"))

    def step(f, row):
        return [{"t": t, "acc": v[0], "gyro": v[1]} for t, v in f.push(row["kind"], row["t"], row["v"])]

    # the last grid time lies strictly before the earliest end, as in the batch form
    ends = acc.unionByName(gyro).groupBy("ride_id", "kind").agg(F.max("t").alias("b")).groupBy("ride_id").agg(F.min("b").alias("end"))
    g = D.fold(acc.unionByName(gyro), "ride_id", ["t", "kind"], lambda: SensorGrid(2, 2.0), step, "ride_id long, t double, acc double, gyro double")
    return g.join(ends, "ride_id").where("t < end - 1e-9").select("ride_id", "t", F.round("acc", 6).alias("acc"), F.round("gyro", 6).alias("gyro"))


@query("q_road_extract", """, w AS (SELECT *, (['primary', 'residential', 'footway', 'service', 'motorway', 'trunk', 'busway', 'track'])[ride_id % 8 + 1] AS kind_ FROM r)
SELECT ride_id AS way, seq AS seg, round(15 + y_mm / 1e8::DOUBLE, 8) AS alat, round(75 + nx / 1e8::DOUBLE, 8) AS blon FROM (SELECT *, lead(x_mm) OVER (PARTITION BY ride_id ORDER BY seq) AS nx FROM w) WHERE nx IS NOT NULL AND kind_ NOT IN ('footway', 'motorway', 'trunk')""")
def road_extract(spark, sf_dir):
    """Rides as the ways of a map extract: segments of those that can be driven."""
    r = rides(spark, sf_dir)
    kinds = F.array(*map(F.lit, ("primary", "residential", "footway", "service", "motorway", "trunk", "busway", "track")))
    point = F.struct((F.lit(15) + F.col("y_mm") / 1e8).alias("lat"), (F.lit(75) + F.col("x_mm") / 1e8).alias("lon"))
    ways = r.groupBy("ride_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", point.alias("p")))), lambda x: x["p"]).alias("geometry"))
    element = F.struct(F.lit("way").alias("type"), F.col("ride_id").alias("id"), "geometry", F.create_map(F.lit("highway"), F.element_at(kinds, (F.col("ride_id") % 8 + 1).cast("int"))).alias("tags"))
    path = folder(spark, "extract")
    # one document a way: as many files as tasks, each read whole
    ways.select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("value")).write.text(path, lineSep="\n")
    d = L.drivable_segments(L.osm_elements(spark, path, lines=True))
    return d.select("way", F.col("seg").cast("long").alias("seg"), F.round("alat", 8).alias("alat"), F.round("blon", 8).alias("blon"))


@query("q_city_pack", """, n AS (SELECT *, ride_id // 16 AS area, row_number() OVER (PARTITION BY ride_id // 16 ORDER BY ride_id, seq) - 1 AS node, round((15 + y_mm / 1e8::DOUBLE) * 1e7)::BIGINT AS lat, round((75 + x_mm / 1e8::DOUBLE) * 1e7)::BIGINT AS lon FROM r)
SELECT 'area ' || area AS area, count(*) AS nodes, round(sum(lat / 1e7::DOUBLE), 5) AS sum_lat, round(sum(lon / 1e7::DOUBLE), 5) AS sum_lon, count(DISTINCT ride_id) AS ways, CAST(sum(node) AS BIGINT) AS refs, count(DISTINCT ride_id) FILTER (WHERE ride_id % 3 = 1) AS oneways, count(*) FILTER (WHERE hit) AS places, CAST(coalesce(sum(node) FILTER (WHERE hit), 0) AS BIGINT) AS arrivals FROM n GROUP BY area""")
def city_pack(spark, sf_dir):
    """City packs built from all rides, sixteen roads an area, and parsed again; a pack is as large as its area."""
    r = rides(spark, sf_dir).withColumn("area", F.floor(F.col("ride_id") / 16))
    degrees7 = lambda base, c: F.round((F.lit(base) + F.col(c) / 1e8) * 1e7).cast("long")
    r = r.withColumn("node", (F.row_number().over(Window.partitionBy("area").orderBy("ride_id", "seq")) - 1).cast("long")).withColumn("lat", degrees7(15, "y_mm")).withColumn("lon", degrees7(75, "x_mm"))
    r = materialize(r.select("area", "ride_id", "seq", "node", "lat", "lon", "hit"), "pack-nodes")
    ordered = lambda by, c: F.transform(F.sort_array(F.collect_list(F.struct(by, c.alias("v")))), lambda x: x["v"])
    ways = r.groupBy("area", "ride_id").agg(F.array_join(F.sort_array(F.collect_list("node")).cast("array<string>"), ",").alias("refs"))
    text = F.concat(F.lit("[["), F.col("refs"), F.lit('],"primary",'), F.when(F.col("ride_id") % 3 == 1, "1").otherwise("0"), F.lit(",0]"))
    ways = ways.groupBy("area").agg(ordered("ride_id", text).alias("ways"))
    stop = F.struct(F.concat(F.lit("stop "), F.col("node")).alias("name"), F.lit("").alias("alt"), F.lit("shop").alias("kind"), "lat", "lon", F.array("node").alias("arrive"))
    nodes = r.groupBy("area").agg(ordered("node", F.col("lat")).alias("lat"), ordered("node", F.col("lon")).alias("lon"), F.sort_array(F.collect_list(F.when(F.col("hit"), stop))).alias("places"))
    path = folder(spark, "pack")
    pack = F.struct(F.lit("track-pack-1").alias("format"), F.concat(F.lit("area "), F.col("area")).alias("area"), "lat", "lon", "ways", "places")
    nodes.join(ways, "area").select(F.to_json(pack).alias("value")).write.text(path)
    nodes, ways, places = L.city_pack(spark, path, "track-pack-1", lines=True)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    n = nodes.groupBy("area").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("lat"), 5).alias("sum_lat"), F.round(F.sum("lon"), 5).alias("sum_lon"))
    w = ways.groupBy("area").agg(F.count(F.lit(1)).alias("ways"), F.sum(total("nodes")).alias("refs"), F.count_if(F.col("oneway") == 1).alias("oneways"))
    p = places.groupBy("area").agg(F.count(F.lit(1)).alias("places"), F.sum(total("arrive")).alias("arrivals"))
    return n.join(w, "area").join(p, "area", "left").fillna(0, ["places", "arrivals"])


@query("q_adhoc_logs", """, e AS (SELECT ride_id, count(*) AS n, max(seq) AS last FROM r GROUP BY ride_id)
SELECT ride_id, n, last::DOUBLE AS seconds, CASE WHEN last > 0 THEN 1.0::DOUBLE END AS hz, round(sum_x, 4) AS sum_x FROM e JOIN (SELECT ride_id, sum(dx_mm / 1000.0::DOUBLE) AS sum_x FROM r GROUP BY ride_id) USING (ride_id) WHERE last > 10""")
def adhoc_logs(spark, sf_dir):
    """Logs of other apps, in seconds, milliseconds or nanoseconds by ride, told by how long they are: rows, length and rate."""
    r = rides(spark, sf_dir).withColumn("last", F.max("seq").over(Window.partitionBy("ride_id"))).where("last > 10")
    unit = F.when(F.col("ride_id") % 3 == 0, 1.0).when(F.col("ride_id") % 3 == 1, 1e3).otherwise(1e9)
    logs = r.select("ride_id", (F.col("seq") * unit + 7).alias("Timestamp"), (F.col("dx_mm") / 1000).alias("Acc_X"), F.lit(0.0).alias("accY"), F.lit(0.0).alias("Z"))
    d = L.adhoc_log(logs, "ride_id")
    g = d.groupBy("ride_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t"), 6).alias("seconds"), F.round(F.sum("x"), 4).alias("sum_x"))
    return g.join(L.rate(d, "t", "ride_id").select("ride_id", F.round("hz", 6).alias("hz")), "ride_id").select("ride_id", "n", "seconds", "hz", "sum_x")


@query("q_inertial_traces", """, lo AS (SELECT ride_id, seq, seq * (CASE WHEN ride_id % 2 = 0 THEN 1 ELSE 1000 END) AS t, dx_mm / 1000.0::DOUBLE - k / 100.0::DOUBLE AS ax, k / 50.0::DOUBLE AS gx, 15 + y_mm / 1e8::DOUBLE AS la, 75 + x_mm / 1e8::DOUBLE AS ln, count(*) OVER (PARTITION BY ride_id) AS n FROM r),
ok AS (SELECT *, arg_max(la, seq) OVER b AS lat, arg_max(ln, seq) OVER b AS lon FROM (SELECT * FROM lo WHERE n >= 50) WINDOW b AS (PARTITION BY ride_id, seq // 3 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
st AS (SELECT * EXCLUDE (lat, lon), max(CASE WHEN seq % 3 = 0 THEN la END) OVER h AS lat, max(CASE WHEN seq % 3 = 0 THEN ln END) OVER h AS lon FROM ok WINDOW h AS (PARTITION BY ride_id, seq // 3)),
g AS (SELECT ride_id, i, i / 2.0::DOUBLE AS t FROM (SELECT ride_id, unnest(range(0, 2 * max(seq))) AS i FROM st GROUP BY ride_id)),
m AS (SELECT g.*, a.ax + (b.ax - a.ax) * (g.t - a.seq) AS ax, a.gx + (b.gx - a.gx) * (g.t - a.seq) AS gx, a.lat + (b.lat - a.lat) * (g.t - a.seq) AS lat, a.lon + (b.lon - a.lon) * (g.t - a.seq) AS lon FROM g JOIN st a ON a.ride_id = g.ride_id AND a.seq = floor(g.t)::BIGINT JOIN st b ON b.ride_id = g.ride_id AND b.seq = a.seq + 1),
f AS (SELECT *, coalesce(lat <> lag(lat) OVER w OR lon <> lag(lon) OVER w, true) AS fix FROM m WINDOW w AS (PARTITION BY ride_id ORDER BY i)),
p AS (SELECT f.*, q.i AS i0, q.lat AS lat0 FROM f ASOF JOIN (SELECT * FROM f WHERE fix) q ON q.ride_id = f.ride_id AND f.i >= q.i),
z AS (SELECT p.*, q.i AS i1, q.lat AS lat1 FROM p ASOF LEFT JOIN (SELECT * FROM f WHERE fix) q ON q.ride_id = p.ride_id AND p.i <= q.i)
SELECT ride_id, i, t, round(ax, 5) AS ax, round(gx, 5) AS gx, round(((CASE WHEN i1 IS NULL OR i1 = i0 THEN lat0 ELSE lat0 + (lat1 - lat0) * (i - i0) / (i1 - i0)::DOUBLE END) - 15) * 1e8::DOUBLE, 3) AS north_mm, fix FROM z""")
def inertial_traces(spark, sf_dir):
    """Logs of 50 rows or more, in seconds or in milliseconds, on one grid of two rows a second: gravity taken off, fixes that stand for three rows spread out."""
    r = rides(spark, sf_dir)
    hold = Window.partitionBy("ride_id", F.floor(F.col("seq") / 3))
    held = lambda base, c: F.max(F.when(F.col("seq") % 3 == 0, F.lit(base) + F.col(c) / 1e8)).over(hold)
    zero = F.lit(0.0)
    logs = r.select("ride_id", "seq", (F.col("seq") * F.when(F.col("ride_id") % 2 == 0, 1).otherwise(1000)).cast("double").alias("t"), (F.col("dx_mm") / 1000).alias("ax"), zero.alias("ay"), zero.alias("az"), (F.col("k") / 50).alias("gx"), zero.alias("gy"), zero.alias("gz"), (F.col("k") / 100).alias("grav_x"), zero.alias("grav_y"), zero.alias("grav_z"), held(15, "y_mm").alias("lat"), held(75, "x_mm").alias("lon"))
    d = L.traces(materialize(logs, "logs"), "ride_id", "seq", hz=2.0, least=50)
    return d.select("ride_id", "i", "t", F.round("ax", 5).alias("ax"), F.round("gx", 5).alias("gx"), F.round((F.col("lat") - 15) * 1e8, 3).alias("north_mm"), "fix")


@query("q_landmark_survey", "SELECT CAST(ride_id % 150 AS INT) AS id, seq, k > 50 AS confirmed, CASE WHEN k > 70 THEN 'bump' ELSE 'hump' END AS type, ride_id % 150 >= 100 AS discovered, CASE WHEN k > 90 THEN NULL ELSE value END AS width_m FROM r WHERE hit")
def landmark_survey(spark, sf_dir):
    """Hits as a landmark survey and back; ids from 100 are discovered ones."""
    h = rides(spark, sf_dir).where("hit")
    s = h.select((F.col("ride_id") % 150).alias("id"), (F.lit(15) + F.col("y_mm") / 1e8).alias("lat"), (F.lit(75) + F.col("x_mm") / 1e8).alias("lon"), F.lit(3.0).alias("gps_acc_m"), F.lit(1.0).alias("crossval_m"), F.when(F.col("k") > 50, "True").otherwise("False").alias("confirmed"), F.lit("landmark").alias("role"), F.when(F.col("k") > 70, "bump").otherwise("hump").alias("type"), F.lit(None).cast("double").alias("gap_to_prev_m"), F.col("seq").alias("paces"), F.when(F.col("k") <= 90, F.col("value")).alias("width_m"))
    return L.landmark_csv(spark, as_csv(s, "survey")).select("id", F.col("paces").cast("long").alias("seq"), "confirmed", "type", "discovered", "width_m")


@query("q_satellite_status", "SELECT event_id, (k % 12 + 1) // 2 AS sats FROM r")
def satellite_status(spark, sf_dir):
    """Satellites in use: of those in view every second one."""
    r = rides(spark, sf_dir)
    view = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") % 12), lambda i: F.struct(i.alias("svid"), (i % 2 == 1).alias("used_in_fix")))
    return L.sats_used(r.select(F.col("event_id").alias("t"), view.alias("satellites"))).select(F.col("t").alias("event_id"), F.col("sats").cast("long").alias("sats"))


@query("q_window_labels", "SELECT event_id, kind AS type, CASE kind WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS label FROM r")
def window_labels(spark, sf_dir):
    """Labels of windows by the place of their type among the classes."""
    r = rides(spark, sf_dir).select("event_id", F.col("kind").alias("type"))
    return L.labelled_windows(r, ["none", "purchase", "click"])


@query("q_feature_collection", "SELECT event_id, round(75 + x_mm / 1e8::DOUBLE, 6) AS lon, round(15 + y_mm / 1e8::DOUBLE, 6) AS lat, 'Point' AS kind, kind AS role FROM r WHERE hit")
def feature_collection(spark, sf_dir):
    """Hits as map features, and what they say."""
    h = rides(spark, sf_dir).where("hit").select("event_id", F.col("kind").alias("role"), (F.lit(75) + F.col("x_mm") / 1e8).alias("lon"), (F.lit(15) + F.col("y_mm") / 1e8).alias("lat"))
    get = lambda path, kind: F.get_json_object("feature", path).cast(kind)
    return K.geojson(h, "lon", "lat", ["event_id", "role"]).select(get("$.properties.event_id", "long").alias("event_id"), F.round(get("$.geometry.coordinates[0]", "double"), 6).alias("lon"), F.round(get("$.geometry.coordinates[1]", "double"), 6).alias("lat"), get("$.geometry.type", "string").alias("kind"), get("$.properties.role", "string").alias("role"))


@query("q_feature_collections", """SELECT ride_id, 'FeatureCollection' AS type, count(*) AS features, min(seq) AS first_seq, CAST(sum(x_mm) AS BIGINT) AS sum_x, CAST(arg_max(y_mm, seq) AS BIGINT) AS last_y FROM r WHERE hit GROUP BY ride_id""")
def feature_collections(spark, sf_dir):
    """A FeatureCollection of every ride's landmarks, written and read back as JSON."""
    docs = K.feature_collections(rides(spark, sf_dir).where("hit"), "ride_id", "seq", "x_mm", "y_mm", ["seq"])
    path = folder(spark, "collections")
    docs.write.parquet(path)
    d = spark.read.parquet(path).withColumn("c", F.from_json("doc", "type string, features array<struct<type: string, geometry: struct<type: string, coordinates: array<bigint>>, properties: struct<seq: bigint>>>"))
    f = F.col("c.features")
    return d.select("ride_id", F.col("c.type").alias("type"), F.size(f).cast("long").alias("features"), f[0]["properties"]["seq"].alias("first_seq"), F.aggregate(f, F.lit(0).cast("long"), lambda t, x: t + x["geometry"]["coordinates"][0]).alias("sum_x"), F.element_at(f, -1)["geometry"]["coordinates"][1].alias("last_y"))


@query("q_summary_docs", SCORES_SQL + "SELECT predictor, count(*) AS n, round(quantile_cont(drift_pct, 0.5), 3) AS median_pct, round(avg(passes::INT), 3) AS pass_rate FROM s GROUP BY predictor")
def summary_docs(spark, sf_dir):
    """A summary for each predictor as JSON."""
    d = K.summary_docs(C.summarise(scores(spark, sf_dir), "predictor"), "predictor")
    get = lambda c, kind: F.get_json_object("doc", f"$.{c}").cast(kind)
    return d.select("predictor", get("n", "long").alias("n"), F.round(get("median_pct", "double"), 3).alias("median_pct"), F.round(get("pass_rate", "double"), 3).alias("pass_rate"))


@query("q_result_csv", SCORES_SQL + "SELECT predictor, target, count(*) AS n, round(sum(final_drift_m), 3) AS drift_sum FROM s GROUP BY predictor, target")
def result_csv(spark, sf_dir):
    """Scores written as a result table, and read again."""
    path = folder(spark, "results")
    K.write_results(scores(spark, sf_dir), path)
    d = spark.read.csv(path, header=True, inferSchema=True)
    return d.groupBy("predictor", F.col("target").cast("long").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("final_drift_m"), 3).alias("drift_sum"))
