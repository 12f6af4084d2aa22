"""What only shows on tables larger than the smallest: by a few made-up rides and by hand."""

import datetime

import pytest

import trackloom.queries as core
from tests.oracle import duck, plain


def events(spark, folder, rows):
    """rows: event_id, user_id, value, k; a second apart. Several files, so that tasks have much and little."""
    t0 = datetime.datetime(2024, 1, 1)
    made = [(e, t0 + datetime.timedelta(seconds=e), u, ("view", "error", "purchase")[e % 3], float(v), f'{{"k": {k}}}') for e, u, v, k in rows]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def many(rides, seconds):
    return [(r * seconds + i, r, (r * 37 + i * 53) % 90 + 0.5, (r * 7 + i * 13) % 101) for r in range(rides) for i in range(seconds)]


def same(spark, name, folder):
    """The query's rows and its SQL's."""
    got = core.queries()[name](spark, folder)
    want = duck(f"{folder}").execute(core.oracle_sql()[name].replace("FROM events", f"FROM read_parquet('{folder}/events.parquet/*.parquet')"))
    names = [d[0] for d in want.description]
    key = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=repr)
    return key(got.select(*names).collect()), key(want.fetchall())


@pytest.fixture
def put_together(spark):
    """Small partitions are put together as on large tables: each side of a union on its own, by its own bytes."""
    confs = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.unionOutputPartitioning": "true"}
    before = {c: spark.conf.get(c) for c in confs}
    for c, v in confs.items():
        spark.conf.set(c, v)
    yield
    for c, v in before.items():
        spark.conf.set(c, v)


def test_sensor_grid_of_many_rides(spark, tmp_path, put_together):
    got, want = same(spark, "q_sensor_grid", events(spark, tmp_path, many(150, 30)))
    assert got == want and len(got) > 5000


def test_nearest_of_tracks_pairs_stay_in_tasks(spark, tmp_path):
    """A small key's pairs are not shuffled, a large key's nearest points are the same by the pyramid."""
    from pyspark.sql import functions as F

    from trackloom.operators import consensus as C
    from trackloom.sources.shared import materialize

    write = lambda d: materialize(d, "nearest")
    rows = [(r, t, j, (j * 531 + t * 97 + r * 11) % 5000, (j * j * 37 + t * 13) % 4000) for r in range(6) for t in range(3) for j in range(4 + 20 * (r == 5))]
    tracks = write(spark.createDataFrame(rows, "ride_id long, track long, j long, x long, y long"))
    stations = tracks.select("ride_id", F.col("track").alias("of"), F.col("j").alias("i"), "x", "y")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    small = C.nearest_of_tracks(stations, tracks, 100, write)
    want = []
    for r, of, i, x, y in key(stations):
        for t in range(3):
            d2, j, px, py = min(((x - px) ** 2 + (y - py) ** 2, j, px, py) for q, u, j, px, py in rows if (q, u) == (r, t))
            want.append((r, of, i, t, j, px, py, d2**0.5))
    assert key(small) == sorted(want)
    mixed = C.nearest_of_tracks(stations, tracks, 100, write, most_pairs=1000)
    assert key(mixed) == sorted(want)
    assert "Window" not in small._jdf.queryExecution().toString()


def test_route_guard_tries_shifts_within_tasks(spark, tmp_path):
    """As the SQL, and no row is formed for each shift: 42 a row were shuffled."""
    folder = events(spark, tmp_path, many(20, 60))
    got, want = same(spark, "q_route_guard_mismatch", folder)
    assert got == want and any(r[2] > 0 for r in got)
    assert same(spark, "q_route_guard", folder)[0] == same(spark, "q_route_guard", folder)[1]
    assert "Generate" not in core.queries()["q_route_guard"](spark, folder)._jdf.queryExecution().toString()


def test_road_advance_ends_by_the_distance_that_it_gives(spark, tmp_path):
    """Sums of these come to 247.99999999999997, which is given as 248."""
    steps = [303.37, 411.38, 308.38, 257.3, 295.88, 111.83, 791.86]
    got, want = same(spark, "q_road_advance", events(spark, tmp_path, [(i, 1, v, 50) for i, v in enumerate(steps)]))
    assert got == want and got[-1][2:] == (248.0, True)
