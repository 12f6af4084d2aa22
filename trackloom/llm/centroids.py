"""Centroid clustering in exact integers, nearest centroids found by partial-distance search.

A vector's components become integers, floor(scale * x). Distances are summed over the dimensions in descending order of their
variance over all vectors, a block of dimensions at a time. After the first block the best centroid so far is measured to the
end; from then on a centroid is abandoned as soon as its partial sum is strictly above the vector's best distance, and those
that survive finish all dimensions. A centroid that could tie is thus never abandoned, and of equal distances the smaller
number wins. What is skipped depends on the order of the dimensions; what is found doesn't.

The integer vectors are written once. A round is one pass over them: each task sends a row of exact sums for each centroid
that it met, so what is shuffled doesn't grow with the vectors, and the centroids (`k` rows) are all that the driver holds.
A lost executor repeats only its part of a round.

Defined results: vectors that are null, have another number of components, or a null, NaN or infinite one are left out; rows
that repeat an id count as often as they occur; a null id is kept, and such rows start as centroids only after all others;
of starts with equal ids the vector that sorts first goes first; with fewer than `k` vectors there are as many centroids as
vectors; centroids that are equal share nothing, the smaller number takes all; an empty table gives an empty result; extra
columns are ignored. A component of 2^27 or more after scaling is an error, for squared distances then leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import materialize

K, ROUNDS, DIMENSIONS, SCALE, BLOCK, BATCH = 40, 5, 64, 256, 8, 2048
#: Components stay below this, so that 64 squared differences fit a signed 64-bit integer.
MOST = 1 << 27


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long): the vectors that are kept, floor(scale * x) of each component."""
    own = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    # comparisons with null are null, with NaN false; an array without one that fails has neither
    finite = F.forall("x", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    kept = own.where((F.size("x") == dimensions) & finite)
    fits = F.forall("x", lambda x: F.abs(x) * scale < MOST - 1)
    checked = F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit(f"a component of {MOST} or more after scaling")).cast("array<double>"))
    return kept.select("vec_id", F.transform(checked, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), -1)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x its nearest centroid and the squared distance, and how many squared differences that took."""
    x, c = x[:, order], centroids[:, order]
    rows, most = np.arange(len(x)), x.shape[1]
    part = np.zeros((len(x), len(c)), np.int64)
    for d in range(min(block, most)):
        part += (x[:, d, None] - c[None, :, d]) ** 2
    lead = part.argmin(1)
    # no centroid is better than the best of the leaders' whole distances
    best = part[rows, lead] + ((x[:, block:] - c[lead][:, block:]) ** 2).sum(1)
    taken = len(x) * (len(c) * min(block, most) + max(0, most - block))
    who, which = np.nonzero(part <= best[:, None])
    own = part[who, which]
    for lo in range(block, most, block):
        own += ((x[who, lo : lo + block] - c[which, lo : lo + block]) ** 2).sum(1)
        taken += len(who) * min(block, most - lo)
        alive = own <= best[who]
        who, which, own = who[alive], which[alive], own[alive]
    # pairs are in order of row and centroid; a stable sort by row and distance leaves the smaller number first
    by = np.lexsort((which, own, who))
    first = by[np.unique(who[by], return_index=True)[1]]
    return which[first], own[first], taken


def _sums(vectors: DataFrame, centroids: np.ndarray | None, order: np.ndarray | None, dimensions: int) -> dict[int, tuple[int, list[int], list[int]]]:
    """By cluster (all in cluster 0 without centroids): count, sums and sums of squares; a row for each task and cluster."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 1 if centroids is None else len(centroids)
        n, s, q = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), np.zeros((k, dimensions))
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.column(0).slice(lo, BATCH))
                own = np.zeros(len(x), np.int64) if centroids is None else nearest(x, centroids, order)[0]
                n += np.bincount(own, minlength=k)
                np.add.at(s, own, x)
                if centroids is None:
                    q[0] += (x.astype(float) ** 2).sum(0)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(n[met], pa.int64()), pa.array(list(s[met]), pa.list_(pa.int64())), pa.array(list(q[met]), pa.list_(pa.float64()))], names=["cluster", "n", "s", "q"])

    parts = vectors.select("v").mapInArrow(add, "cluster long, n long, s array<long>, q array<double>")
    each = parts.select("cluster", "n", F.posexplode(F.arrays_zip("s", "q")).alias("d", "x")).groupBy("cluster", "d")
    found = each.agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q"))
    out: dict[int, tuple[int, list[int], list[int]]] = {}
    for r in found.orderBy("cluster", "d").collect():  # k * dimensions rows
        n, s, q = out.setdefault(r["cluster"], (r["n"], [], []))
        s.append(r["s"])
        q.append(r["q"])
    return out


def starts(vectors: DataFrame, k: int = K, seed: str = "2") -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in got], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = "2") -> DataFrame:
    """A row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid_size."""
    spark = vectors.sparkSession
    whole = materialize(integer_vectors(vectors, id_col, vector_col, dimensions, scale), "centroid-vectors")
    names = "vec_id long, cluster int, distance long"
    centroids = starts(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], names + ", cluster_inertia long, inertia long, centroid_sha256 string, centroid_size long")
    n, s, q = _sums(whole, None, None, dimensions)[0]
    order = np.argsort(-(np.array(q) / n - (np.array(s, float) / n) ** 2), kind="stable")
    for _ in range(rounds):
        for c, (n, s, _) in _sums(whole, centroids, order, dimensions).items():
            centroids[c] = [x // n for x in s]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.slice(lo, BATCH)
                own, distance, _ = nearest(_matrix(some.column(1)), centroids, order)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(own, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    last = materialize(whole.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(assign, names), "centroid-last")
    sizes = {r["cluster"]: r for r in last.groupBy("cluster").agg(F.sum("distance").alias("d"), F.count(F.lit(1)).alias("n")).collect()}  # k rows
    total = sum(r["d"] for r in sizes.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = spark.createDataFrame([(c, r["d"], total, digests[c], r["n"]) for c, r in sizes.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid_size long")
    return last.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid_size")
