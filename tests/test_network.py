"""The residual network: by definition, gradients by differences, summed over tasks, and learning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import network as N


def small(seed=1, window=24):
    net = N.ResidualNet(channels=2, window=window, base=3, layers=(1, 1), hidden=5, seed=seed)
    rng = np.random.default_rng(seed)
    for k in net.weights:
        if k.endswith((".g", ".s")):
            net.weights[k] = net.weights[k] + rng.normal(0, 0.1, net.weights[k].shape)
    for k in net.stats:
        net.stats[k] = net.stats[k] + rng.uniform(0, 0.3, net.stats[k].shape)
    return net


def plain_unit(net, x, name, stride, pad):
    """One convolution and normalisation, number by number."""
    w = net.weights[name]
    o, c, k = w.shape
    size = (len(x[0]) + 2 * pad - k) // stride + 1
    out = []
    for i in range(o):
        row = []
        for t in range(size):
            s = sum(w[i, j, q] * x[j][t * stride + q - pad] for j in range(c) for q in range(k) if 0 <= t * stride + q - pad < len(x[j]))
            row.append((s - net.stats[f"{name}.m"][i]) / math.sqrt(net.stats[f"{name}.v"][i] + N.EPS) * net.weights[f"{name}.g"][i] + net.weights[f"{name}.s"][i])
        out.append(row)
    return out


def plain(net, x):
    relu = lambda rows: [[max(v, 0.0) for v in r] for r in rows]
    x = relu(plain_unit(net, x.tolist(), "stem", 2, 3))
    x = [[max(r[max(0, 2 * t - 1) : 2 * t + 2]) for t in range((len(r) - 1) // 2 + 1)] for r in x]
    for name, a, b, stride in net.blocks:
        y = plain_unit(net, relu(plain_unit(net, x, f"{name}.1", stride, 1)), f"{name}.2", 1, 1)
        skip = plain_unit(net, x, f"{name}.d", stride, 0) if f"{name}.d" in net.weights else x
        x = relu([[p + q for p, q in zip(r, s)] for r, s in zip(y, skip)])
    mean = [sum(r) / len(r) for r in x]
    hidden = [max(0.0, sum(w * m for w, m in zip(row, mean)) + s) for row, s in zip(net.weights["h1"], net.weights["h1.s"])]
    return sum(w * h for w, h in zip(net.weights["h2"][0], hidden)) + net.weights["h2.s"][0]


def test_forward_number_by_number():
    net, x = small(), np.random.default_rng(2).normal(0, 1, (3, 2, 24))
    assert np.allclose(net.forward(x), [plain(net, r) for r in x], atol=1e-10)
    with pytest.raises(ValueError, match="windows"):
        net.forward(x[:, :, :20])


def test_gradients_by_differences():
    net, rng = small(3), np.random.default_rng(4)
    x, y = rng.normal(0, 1, (5, 2, 24)), rng.normal(0, 2, 5)
    _, grads = net.loss_gradients(x, y)
    assert set(grads) == set(net.weights)
    for k, w in net.weights.items():
        flat = w.ravel()
        for i in rng.choice(w.size, min(4, w.size), replace=False):
            before, found = flat[i], []
            for e in (1e-6, -1e-6):
                flat[i] = before + e
                found.append(net.loss_gradients(x, y)[0])
            flat[i] = before
            assert math.isclose((found[0] - found[1]) / 2e-6, grads[k].ravel()[i], rel_tol=2e-3, abs_tol=1e-5), (k, i)


def test_one_cycle():
    rates = [N.one_cycle(i, 100, 1.0) for i in range(100)]
    assert math.isclose(rates[0], 0.04) and math.isclose(rates[29], 1.0) and rates[-1] < 1e-5
    assert rates[:30] == sorted(rates[:30]) and rates[29:] == sorted(rates[29:], reverse=True)


def windows(spark, rides=6, each=60):
    """Distance grows with how much the first channel swings."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(rides * each):
        size = rng.uniform(0.2, 2)
        x = np.stack([size * np.sin(np.arange(24) * rng.uniform(0.8, 1.2) + rng.uniform(0, 6)), rng.normal(0, 0.3, 24)])
        rows.append((i, i % rides, x.ravel().tolist(), float(3 * size)))
    return spark.createDataFrame(rows, "id long, ride_id long, x array<double>, y double")


def test_gradients_do_not_depend_on_how_rows_are_dealt(spark):
    df, net = windows(spark, each=10), small()
    a = N.gradients_of(df.coalesce(1), net)
    b = N.gradients_of(df.repartition(7).unionByName(df.limit(1).withColumn("y", F.lit(None).cast("double"))), net)
    assert a[0] == b[0] == 60 and math.isclose(a[1], b[1]) and all(np.allclose(a[2][k], b[2][k]) for k in a[2])
    assert N.gradients_of(df.limit(0), net)[0] == 0 and N.train(df.limit(0), net, 1, 1) == []


def test_held_out_rides_are_told_better_than_by_the_mean(spark):
    df = windows(spark).cache()
    learned, held = df.where("ride_id > 0"), df.where("ride_id = 0")
    net = N.ResidualNet(channels=2, window=24, base=4, layers=(1, 1), hidden=8)
    losses = N.train(learned, net, epochs=20, batches=3, rate=0.02)
    mean = learned.agg(F.avg("y")).first()[0]
    r = N.predict(held, net, ["id", "y"]).agg(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("y"), 2))).alias("net"), F.sqrt(F.avg(F.pow(F.lit(mean) - F.col("y"), 2))).alias("mean")).first()
    df.unpersist()
    assert losses[-1] < losses[0] and r["net"] < 0.75 * r["mean"]
