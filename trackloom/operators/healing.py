"""A map of landmarks that mends itself: hits of many runs become candidates, and those that runs pass without a hit fade.

Areas are independent states. Within one, candidates are found by cells of the clustering distance, so a hit looks at nine cells however many
candidates there are. Rows of a run come together: its hits first, then the places that it passed. What is kept of the runs
is their number and the last one, so a candidate doesn't grow with the runs that have met it.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import fold as D

CANDIDATE = "area string, x double, y double, n long, runs long, last_run string, misses long, kinds map<string,long>"


class HealingMap:
    """observe() takes a hit, pass_by() a place of the run's way; end_run() lets candidates fade that were passed and not hit."""

    def __init__(self, cluster: float = 12.0, corridor: float = 25.0, limit: int = 3):
        self.cluster, self.corridor, self.limit = cluster, corridor, limit
        self.rows: dict[int, dict] = {}
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.next, self.run, self.passed = 0, None, set()

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.cluster), math.floor(y / self.cluster)

    def add(self, row: dict) -> int:
        k, self.next = self.next, self.next + 1
        self.rows[k] = row
        self.cells.setdefault(self._cell(row["x"], row["y"]), set()).add(k)
        return k

    def _near(self, x: float, y: float, distance: float) -> list[tuple[float, int]]:
        (cx, cy), r = self._cell(x, y), math.ceil(distance / self.cluster)
        keys = (k for i in range(-r, r + 1) for j in range(-r, r + 1) for k in self.cells.get((cx + i, cy + j), ()))
        return sorted((d, k) for k in keys if (d := math.dist((x, y), (self.rows[k]["x"], self.rows[k]["y"]))) <= distance)

    def observe(self, run: str, x: float, y: float, kind: str) -> None:
        near = self._near(x, y, self.cluster)
        if not near:
            self.add({"x": x, "y": y, "n": 1, "runs": 1, "last_run": run, "misses": 0, "kinds": {kind: 1}})
            return
        k = near[0][1]
        c = self.rows[k]
        self.cells[self._cell(c["x"], c["y"])].discard(k)
        w = c["n"] / (c["n"] + 1.0)
        c["x"], c["y"], c["n"] = c["x"] * w + x * (1 - w), c["y"] * w + y * (1 - w), c["n"] + 1
        c["runs"], c["last_run"] = c["runs"] + (c["last_run"] != run), run
        c["kinds"] = dict(Counter(c["kinds"]) + Counter({kind: 1}))
        self.cells.setdefault(self._cell(c["x"], c["y"]), set()).add(k)

    def pass_by(self, x: float, y: float) -> None:
        self.passed.update(k for _, k in self._near(x, y, self.corridor))

    def end_run(self, run: str) -> None:
        for k in self.passed:
            c = self.rows[k]
            if c["last_run"] != run:
                c["misses"] += 1
                if c["misses"] >= self.limit:
                    self.cells[self._cell(c["x"], c["y"])].discard(k)
                    del self.rows[k]
        self.passed = set()

    def step(self, row: dict) -> None:
        if row["what"] == 0:
            self.add({c: row[c] for c in ("x", "y", "n", "runs", "last_run", "misses")} | {"kinds": dict(row["kinds"])})
            return
        if self.run is not None and row["run"] != self.run:
            self.end_run(self.run)
        self.run = row["run"]
        if row["what"] == 1:
            self.observe(row["run"], row["x"], row["y"], row["kind"])
        else:
            self.pass_by(row["x"], row["y"])

    def finish(self) -> list[dict]:
        if self.run is not None:
            self.end_run(self.run)
        return list(self.rows.values())


def heal(known: DataFrame | None, hits: DataFrame, ways: DataFrame, size: float = 2000.0, cluster: float = 12.0, corridor: float = 25.0, limit: int = 3) -> DataFrame:
    """The map(area, x, y, n, runs, last_run, misses, kinds) after hits(run, t, x, y, kind) and ways(run, t, x, y) of runs, in order of run.

    Areas are squares of `size`; a way is told to all areas that it comes near, a hit to its own only, so a landmark on a border may be two candidates.
    A run's rows must come in one call.
    """
    area = lambda x, y: F.concat_ws(":", F.floor(x / size).cast("long"), F.floor(y / size).cast("long"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("runs", "long"), ("last_run", "string"), ("misses", "long"), ("kinds", "map<string,long>"))]
    own = hits.select(area(F.col("x"), F.col("y")).alias("area"), F.col("run").cast("string").alias("run"), F.lit(1).alias("what"), F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "kind", *none)
    span = lambda c: F.sequence(F.floor((F.col(c) - corridor) / size).cast("long"), F.floor((F.col(c) + corridor) / size).cast("long"))
    near = ways.withColumn("__i", F.explode(span("x"))).withColumn("__j", F.explode(span("y")))
    went = near.select(F.concat_ws(":", "__i", "__j").alias("area"), F.col("run").cast("string").alias("run"), F.lit(2).alias("what"), F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(None).cast("string").alias("kind"), *none)
    rows = own.unionByName(went)
    if known is not None:
        rows = rows.unionByName(known.select("area", F.lit("").alias("run"), F.lit(0).alias("what"), F.lit(0.0).alias("t"), "x", "y", F.lit(None).cast("string").alias("kind"), "n", "runs", "last_run", "misses", "kinds"))
    return D.fold(rows.withColumn("__known", F.col("what") > 0), "area", ["__known", "run", "what", "t", "x", "y"], lambda: HealingMap(cluster, corridor, limit), lambda f, row: f.step({**row, "kinds": row["kinds"] or []}), CANDIDATE, lambda f, key: f.finish())


def published(known: DataFrame, runs: int = 2) -> DataFrame:
    """Candidates that `runs` runs have met, with the kind that most hits had and the confidence that the runs give."""
    kinds = F.transform(F.map_entries("kinds"), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("kind")))
    return known.where(F.col("runs") >= runs).select("area", "x", "y", "n", "runs", "misses", F.array_min(kinds)["kind"].alias("kind"), (1 - F.pow(F.lit(0.5), F.col("runs"))).alias("confidence"))
