"""A learned speed model in Spark ML with the same split protocol as the neural one: leave one ride out, fixed settings."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_features(windows: DataFrame, col: str = "window") -> DataFrame:
    """Mean, deviation, least and greatest of each window, as columns f0..f3."""
    n = F.size(col)
    total = F.aggregate(col, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(col, F.lit(0.0), lambda a, x: a + F.pow(x, 2))
    mean = total / n
    return windows.select("*", mean.alias("f0"), F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))).alias("f1"), F.array_min(col).cast("double").alias("f2"), F.array_max(col).cast("double").alias("f3"))


def leave_one_out(features: DataFrame, held: list[int], key: str = "ride_id", label: str = "label", inputs: tuple[str, ...] = ("f0", "f1", "f2", "f3")) -> list[dict]:
    """For each held-out ride: its error with the model of all others, and with the others' mean. One fit a ride named."""
    data = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(features).select(key, F.col(label).cast("double").alias("label"), "features")
    out = []
    for ride in held:
        others, own = data.where(F.col(key) != ride), data.where(F.col(key) == ride)
        model = LinearRegression(regParam=1e-3, maxIter=50).fit(others)
        mean = others.agg(F.avg("label")).first()[0]
        got = model.transform(own).agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("error"), F.avg(F.abs(F.lit(mean) - F.col("label"))).alias("by_mean")).first()
        out.append({"ride": ride, "error": got["error"], "by_mean": got["by_mean"]})
    return out
