"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import discard, materialize


def _state() -> list[Column]:
    """What tells one edge table from another: the number of edges and the sum of their hashes."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")]


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """m: of each node u the least of itself and its neighbours v. Combined map-side, so hubs are no burden."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of comparable ids -> node, root: the least id reachable, for every node that has an edge. A written table.

    Each round hangs the larger neighbours of a node on its least neighbour (large star), then the smaller ones
    (small star), until nothing changes; the number of rounds grows with the logarithm of a component's size.
    No neighbourhood is ever collected: a round is two aggregations and two joins, written to the shared
    folder; what the round before has written goes. The joins are by sorting whatever the sizes: a round that broadcasts keeps
    threads and buffers in the driver for tables that next to nothing is gained by.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges", *_state())
    if not e.figures["n"]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both).hint("merge"), F.col("u") == F.col("n")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _least_neighbour(large)
        hung = large.join(near.hint("merge"), F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(near.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "cc-edges", *_state())
        before, e = e, now
        discard(before)
        if now.figures == before.figures:
            break
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = materialize(found, "cc-roots")
    discard(e)
    return out


def merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of roots(node, root) once links(a, b) are added: node, root. Only links between components are searched."""
    up = {c: roots.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(f"r_{c}")) for c in "ab"}
    between = links.join(up["a"], F.col("a") == F.col("n_a"), "left").join(up["b"], F.col("b") == F.col("n_b"), "left")
    top = components(between.select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))).toDF("of", "top")
    old = roots.join(top, F.col("root") == F.col("of"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(top.join(roots, F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("node"), F.col("top").alias("root")))
