"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from trackloom.llm import centroids

from oracle import compare

SF = "/root/testdata/sf0.001"
COLUMNS = "vec_id long, embedding array<float>, label int"


def test_against_sql(spark):
    assert compare(spark, entry, "op11_centroid_clustering", SF) > 0


def brute(vectors, k, rounds, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [list(v) for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    return sorted(((i is None, i or 0, j, d, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last)), sum(d for _, d, _ in last)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.5) * (d % 7 == 0) + rng.gauss(0, 0.05) for d in range(64)] for _ in range(12)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in base[i % 12]]) for i in range(150)]
    rows += [(7, rows[7][1]), (8, rows[30][1]), (None, rows[31][1]), (400, rows[0][1]), (401, rows[0][1])]
    got = centroids.cluster_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], COLUMNS).repartition(5), k=9, rounds=3).collect()
    want, inertia = brute(rows, 9, 3)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["centroid_sha256"]) for r in got) == want
    assert {r["inertia"] for r in got} == {inertia}
    by = {}
    for r in got:
        by[r["cluster"]] = by.get(r["cluster"], 0) + r["distance"]
    assert all(by[r["cluster"]] == r["cluster_inertia"] for r in got)


def test_partial_distances_equal_whole_ones_and_save_work():
    rng = np.random.default_rng(5)
    spread = np.where(np.arange(64) % 4 == 0, 200, 8)
    c = (rng.normal(0, 1, (40, 64)) * spread).astype(np.int64)
    x = c[rng.integers(0, 40, 3000)] + rng.integers(-9, 10, (3000, 64))
    c = np.concatenate([c, c[:3]])  # equal centroids: the smaller number
    whole = ((x[:, None, :] - c[None]) ** 2).sum(2)
    own, distance, taken = centroids.nearest(x, c, np.argsort(-spread, kind="stable"))
    assert (own == whole.argmin(1)).all() and (distance == whole.min(1)).all()
    assert taken < 0.35 * x.size * len(c)
    tied = np.array([[0, 0], [2, 0], [0, 2], [2, 2]])
    assert centroids.nearest(np.array([[1, 1]]), tied, np.array([1, 0]), block=1)[0].tolist() == [0]


def test_odd_vectors(spark):
    ok, inf, nan = [0.5] * 64, [float("inf")] + [0.0] * 63, [float("nan")] + [0.0] * 63
    rows = [(1, ok, 1), (2, None, 1), (3, [], 1), (4, [1.0], 1), (5, inf, 1), (6, nan, 1), (7, [None] + ok[1:], 1), (8, ok + [1.0], 1), (None, ok, None), (1, ok, 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS + ", cluster string, v string")
    got = centroids.cluster_vectors(df).collect()
    # three equal vectors give three equal centroids, of which the first takes all
    assert sorted((r["vec_id"] or 0, r["cluster"], r["distance"], r["centroid_size"]) for r in got) == [(0, 0, 0, 3), (1, 0, 0, 3), (1, 0, 0, 3)]
    assert centroids.cluster_vectors(spark.createDataFrame([], COLUMNS)).count() == 0
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] + [0.0] * 63, 0)], COLUMNS))


def test_below_zero_sums_are_floored(spark):
    rows = [(i, [-1 / 256 * (i % 2)] * 64, 0) for i in range(5)]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, COLUMNS), k=1, rounds=1).collect()
    assert {r["centroid_sha256"] for r in got} == {hashlib.sha256(",".join(["-1"] * 64).encode()).hexdigest()}
