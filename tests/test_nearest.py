"""Exact nearest neighbours, coverage and places against brute force."""

import math
import random

import pytest

from trackloom.operators import consensus as C
from trackloom.operators.nearest import coverage, nearest
from trackloom.operators.places import arrivals, merge_places
from trackloom.sources.shared import materialize


def write(d):
    return materialize(d, "test")


@pytest.mark.parametrize("seed,finest", [(1, 10), (2, 1000), (3, 3)])
def test_nearest_equals_brute_force(spark, seed, finest):
    """Far points, many targets in one cell, targets at one place, ties."""
    rng = random.Random(seed)
    t = [(i, rng.randint(0, 40), rng.randint(0, 40)) for i in range(150)] + [(150 + i, rng.randint(-9000, 9000), rng.randint(-9000, 9000)) for i in range(30)] + [(999, None, 3)]
    p = [(i, rng.randint(-20000, 20000), rng.randint(-20000, 20000)) for i in range(60)] + [(60 + i, rng.randint(-5, 50), rng.randint(-5, 50)) for i in range(60)] + [(500, None, 1)]
    got = {r["id"]: (r["target"], r["d2"]) for r in nearest(spark.createDataFrame(p, "id long, x long, y long"), spark.createDataFrame(t, "target long, tx long, ty long"), ["id"], write, finest).collect()}
    for i, x, y in p:
        if x is not None:
            best = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in t if a is not None)
            assert got[i] == (best[1], best[0])
    assert 500 not in got and len(got) == 120


def test_nearest_within_keys_and_without_targets(spark):
    p = spark.createDataFrame([(1, 7, 0, 0), (2, 8, 0, 0), (3, 9, 0, 0)], "id long, k long, x long, y long")
    t = spark.createDataFrame([(1, 7, 100, 0), (2, 8, 5000, 5000), (3, 8, -4000, 0)], "target long, k long, tx long, ty long")
    got = {r["id"]: r["target"] for r in nearest(p, t, ["id", "k"], write, 10, keys=("k",)).collect()}
    assert got == {1: 1, 2: 3}
    assert nearest(p, t.limit(0), ["id"], write, 10).count() == 0


def test_coverage_names_what_is_outside(spark):
    road = spark.createDataFrame([(0, x * 50, y * 50) for x in range(40) for y in range(40)], "target int, tx long, ty long")
    points = [(1, i, 600 + i, 600) for i in range(20)] + [(2, i, 1940 + i, 600) for i in range(20)] + [(3, i, 1900 + 30 * i, 600) for i in range(20)] + [(4, i, 600, 600) for i in range(5)]
    got = {r["ride_id"]: (r["gate"], round(r["worst"]), r["margin"]) for r in coverage(spark.createDataFrame(points, "ride_id long, seq long, x long, y long"), road, write, 50).collect()}
    assert got[1][0] == "OK" and got[2] == ("FAIL", 10, -9.0) and got[3] == ("FAIL", 520, -520.0) and got[4][0] == "SKIP"


def test_arrivals_fall_back_to_the_nearest_node(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 30.0, 0.0), (3, 55.0, 0.0), (4, 5000.0, 0.0)], "node long, nx double, ny double")
    places = spark.createDataFrame([(10, True, 0.0, 0.0), (10, True, 20.0, 0.0), (11, False, 0.0, 0.0), (12, True, 900.0, 0.0), (13, False, 1e6, 0.0)], "place long, outlined boolean, x double, y double")
    got = {r["place"]: r["arrive"] for r in arrivals(places, nodes, 40, 60, write).collect()}
    assert got == {10: [1, 2, 3], 11: [1, 2, 3], 12: [3], 13: [4]}


def test_places_of_one_name_are_merged(spark):
    rng = random.Random(6)
    rows = [("a" if i % 3 else "b", i, rng.uniform(0, 2000), rng.uniform(0, 2000), [rng.randrange(60) for _ in range(rng.randint(0, 5))]) for i in range(120)] + [("c", 500, 0.0, 0.0, None)]
    got = {(r["name"], r["place"]): (r["merged"], r["arrive"]) for r in merge_places(spark.createDataFrame(rows, "name string, place long, x double, y double, arrive array<long>"), 300).collect()}
    kept = []
    for name, place, x, y, arrive in sorted(rows, key=lambda r: (-len(r[4] or []), r[1])):
        twin = next((q for q in kept if q[0] == name and math.dist((x, y), q[2]) < 300), None)
        if twin:
            twin[3] += 1
            twin[4].update(arrive or [])
        else:
            kept.append([name, place, (x, y), 1, set(arrive or [])])
    assert got == {(q[0], q[1]): (q[3], sorted(q[4])) for q in kept}


def test_consensus_is_stationed_on_its_own_result(spark):
    """Of three straight tracks, one of them 40 m off in the middle, the median stays on the road; stations are two metres apart."""
    def track(t, off):
        return [(1, t, j, j * 7.0, (off if 300 < j * 7 < 500 else 0) + t * 0.5) for j in range(120)]

    tracks = spark.createDataFrame(track(0, 0) + track(1, 0) + track(2, 40), "ride_id long, track long, j long, x double, y double")
    line = C.consensus(tracks, 10, write, step=2.0).orderBy("i").collect()
    assert [r["i"] for r in line] == list(range(len(line)))
    assert max(abs(r["y"]) for r in line) <= 1.0
    assert all(abs(math.dist((a["x"], a["y"]), (b["x"], b["y"])) - 2) < 0.05 for a, b in zip(line, line[1:]))
    mean = C.consensus(tracks, 10, write, how="mean", step=2.0).collect()
    assert max(r["y"] for r in mean) > 10
