"""Places by name: entries of one name near each other become one; where a place can be reached."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import fold as D
from trackloom.operators.nearest import nearest
from trackloom.operators.spatial import within_radius


class _Kept:
    """Entries of a name that stay, found by cells as wide as the distance within which others join them."""

    def __init__(self, least: float):
        self.least, self.rows, self.cells = least, [], {}

    def take(self, row: dict) -> None:
        cx, cy = math.floor(row["x"] / self.least), math.floor(row["y"] / self.least)
        near = (k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in self.cells.get((cx + i, cy + j), ()))
        twin = min((k for k in near if math.dist((row["x"], row["y"]), (self.rows[k]["x"], self.rows[k]["y"])) < self.least), default=None)
        if twin is None:
            self.cells.setdefault((cx, cy), []).append(len(self.rows))
            self.rows.append({"place": row["place"], "x": row["x"], "y": row["y"], "merged": 1, "arrive": set(row["arrive"])})
        else:
            self.rows[twin]["merged"] += 1
            self.rows[twin]["arrive"] |= set(row["arrive"])


def merge_places(places: DataFrame, least: float) -> DataFrame:
    """name, place, x, y, merged, arrive: of entries(name, place, x, y, arrive) with one name within `least`, the one with most arrivals
    (of equals the least), where it is, with the arrivals of all. The state is what stays of one name; names are dealt to tasks."""
    rows = places.select("name", "place", "x", "y", F.coalesce("arrive", F.array().cast("array<long>")).alias("arrive")).withColumn("rank", -F.size("arrive"))
    kinds = dict(rows.dtypes)
    schema = f"name string, place {kinds['place']}, x {kinds['x']}, y {kinds['y']}, merged long, arrive {kinds['arrive']}"
    return D.fold(rows, "name", ["rank", "place"], lambda: _Kept(least), lambda f, row: f.take(row), schema, lambda f, name: [{**r, "arrive": sorted(r["arrive"])} for r in f.rows])


def arrivals(places: DataFrame, nodes: DataFrame, of_outline: int, of_point: int, write) -> DataFrame:
    """place, arrive (nodes, sorted), least_d2: nodes within `of_outline` of places with an outline, `of_point` of others; where there are none, the nearest node.

    places(place, outlined, x, y): a row for each point of an outline; nodes(node, nx, ny).
    """
    near = within_radius(places, nodes, max(of_outline, of_point), "x", "y", "nx", "ny").where(F.col("d2") <= F.when(F.col("outlined"), of_outline * of_outline).otherwise(of_point * of_point))
    found = write(near.groupBy("place").agg(F.sort_array(F.collect_set("node")).alias("arrive"), F.min("d2").alias("least_d2")))
    left = write(places.join(found, "place", "left_anti"))
    far = nearest(left, nodes, ["place"], write, max(of_outline, of_point), tx="nx", ty="ny", target="node").groupBy("place").agg(F.min(F.struct("d2", "target")).alias("b"))
    return found.unionByName(far.select("place", F.array("b.target").alias("arrive"), F.col("b.d2").alias("least_d2")))
