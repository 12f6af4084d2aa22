"""Queries of the sinks and of their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.geo import R_EQUATOR
from trackloom.operators import outage as O
from trackloom.operators import predict as P
from trackloom.plans._register import Register
from trackloom.plans.scoring import SCORES_SQL, outages, scores
from trackloom.plans.spatial import candidates
from trackloom.sources import sinks as K
from trackloom.sources.rides import RIDES_SQL, rides

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query
KEYS = ["ride_id", "target", "i0", "i1"]


def _runs(spark, sf_dir):
    r, o = outages(spark, sf_dir)
    o = o.select(*KEYS).distinct()
    return K.run_files(P.predict_closed(o, r, O.initial_state(r)), scores(spark, sf_dir), KEYS, "synthetic")


@query("q_run_files", SCORES_SQL + "SELECT ride_id, target, i0, i1, predictor, i1 - i0 + 1 AS samples, CASE WHEN passes THEN 'true' ELSE 'false' END AS passes, round(round(final_drift_m, 2), 1) AS drift, 't,truth,pred,sigma_m,terrain,speed_mps' AS sample_keys, 'final_drift_m,drift_pct,ate_m,passes_isro' AS metric_keys FROM s")
def run_files(spark, sf_dir):
    d = _runs(spark, sf_dir)
    keys = lambda path: F.array_join(F.json_object_keys(F.get_json_object("doc", path)), ",")
    return d.select(*KEYS, "predictor", F.json_array_length(F.get_json_object("doc", "$.samples")).cast("long").alias("samples"), F.get_json_object("doc", "$.metrics.passes_isro").alias("passes"), F.round(F.get_json_object("doc", "$.metrics.final_drift_m").cast("double"), 1).alias("drift"), keys("$.samples[0]").alias("sample_keys"), keys("$.metrics").alias("metric_keys"))


@query("q_run_file_problems", SCORES_SQL + "SELECT predictor, ride_id % 4 AS fault, count(*) AS files, CASE ride_id % 4 WHEN 1 THEN 'samples is empty' WHEN 2 THEN 'metrics.ate_m' WHEN 3 THEN 'schema_version,run_id,source,origin,vehicle,mount,blackout,samples,landmarks,guidance,metrics' ELSE '' END AS problems FROM s GROUP BY ALL")
def run_file_problems(spark, sf_dir):
    """Run files of which three of four are spoilt: without samples, without a metric, cut short."""
    d = _runs(spark, sf_dir).withColumn("fault", F.col("ride_id") % 4)
    doc = F.col("doc")
    spoilt = F.when(F.col("fault") == 1, F.regexp_replace(doc, r'"samples":\[.*?\}\]', '"samples":[]')).when(F.col("fault") == 2, F.regexp_replace(doc, '"ate_m":', '"ate":')).when(F.col("fault") == 3, F.substring(doc, F.lit(1), F.length(doc) - 1)).otherwise(doc)
    return K.run_file_problems(d.withColumn("doc", spoilt)).groupBy("predictor", "fault", F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("files"))


@query("q_osm_export", f""", c AS (SELECT (list(what ORDER BY same DESC, what))[1] AS kind, count(*) AS n, count(DISTINCT ride_id) AS runs, CAST(sum(x_mm) AS DOUBLE) / count(*) / 1000 AS x, CAST(sum(y_mm) AS DOUBLE) / count(*) / 1000 AS y FROM (SELECT *, count(*) OVER (PARTITION BY fx, fy, what) AS same FROM (SELECT *, (['bump', 'hump', 'table'])[k % 3 + 1] AS what, floor(x_mm / 12000.0::DOUBLE) AS fx, floor(y_mm / 12000.0::DOUBLE) AS fy FROM r WHERE hit)) GROUP BY fx, fy HAVING count(DISTINCT ride_id) >= 2)
SELECT -row_number() OVER (ORDER BY x, y) AS id, 'node' AS type, round(15.36::DOUBLE + degrees(y / {R_EQUATOR!r}), 6) AS lat, round(75.12::DOUBLE + degrees(x / (cos(radians(15.36::DOUBLE)) * {R_EQUATOR!r})), 6) AS lon, kind, 'crowdsourced' AS source, CAST(n AS VARCHAR) AS observations, round(1 - pow(0.5::DOUBLE, runs), 2) AS confidence FROM c""")
def osm_export(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("x", F.col("x") / 1000).withColumn("y", F.col("y") / 1000)
    get = lambda path, kind="string": F.get_json_object("node", f"$.{path}").cast(kind)
    d = K.osm_nodes(c, 15.36, 75.12, "crowdsourced")
    return d.select(get("id", "long").alias("id"), get("type").alias("type"), F.round(get("lat", "double"), 6).alias("lat"), F.round(get("lon", "double"), 6).alias("lon"), get("tags.traffic_calming").alias("kind"), get("tags.source").alias("source"), get("tags.observations").alias("observations"), F.round(get("tags.confidence", "double"), 2).alias("confidence"))


@query("q_route_upsert", """, n AS (SELECT ride_id AS name, max(d_mm) AS length_mm, count(*) AS n_points, 'learned' AS source FROM r WHERE hit GROUP BY ride_id),
o AS (SELECT ride_id AS name, max(d_mm) AS length_mm, count(*) AS n_points, 'shipped' AS source FROM r GROUP BY ride_id)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE name NOT IN (SELECT name FROM n)""")
def route_upsert(spark, sf_dir):
    r = rides(spark, sf_dir)
    routes = lambda d, source: d.groupBy(F.col("ride_id").alias("name")).agg(F.max("d_mm").alias("length_mm"), F.count(F.lit(1)).alias("n_points")).withColumn("source", F.lit(source))
    return K.upsert_routes(routes(r, "shipped"), routes(r.where("hit"), "learned"))


@query("q_trip_summary", "SELECT ride_id AS trip, max(seq) AS duration_s, count(*) FILTER (WHERE NOT gnss_ok) AS denied, true AS missing_is_null, 'missing,endless' AS nulls FROM r GROUP BY ride_id")
def trip_summary(spark, sf_dir):
    t = rides(spark, sf_dir).groupBy(F.col("ride_id").alias("trip")).agg(F.max("seq").alias("duration_s"), F.count_if(~F.col("gnss_ok")).alias("denied"), F.max("value").alias("fastest"), F.lit(float("nan")).alias("missing"), F.lit(float("inf")).alias("endless"))
    d = K.trip_summary(t)
    return d.select("trip", F.get_json_object("doc", "$.duration_s").cast("long").alias("duration_s"), F.get_json_object("doc", "$.denied").cast("long").alias("denied"), F.col("doc").contains('"missing":null').alias("missing_is_null"), F.array_join(F.regexp_extract_all("doc", F.lit(r'"(\w+)":null'), F.lit(1)), ",").alias("nulls"))
