"""Geometry: point in polygon, areas, distances between zones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_km
from ..functions.kernels import simplify
from .entity import near_cells


def rings(edges: DataFrame) -> DataFrame:
    """zone_id, ring, its bounds and the grid laid over them: n_rows by n_cols cells, about as many as it has edges at most.

    Rows are as many as leave an edge in four of them on average, so a cell of an outline of short edges holds few. Columns are eight at most, as an
    edge that ends in a row is kept with all cells left of it. So rows where the outline runs level hold many: of 100,000 edges of a jagged coast the
    fullest cell keeps 1,793, and an edge is kept 19 times. If most edges go through most of the height, a cell still holds most of them.
    """
    n, high, wide = F.count("*"), F.max("y1") - F.min("y1"), F.max("x1") - F.min("x1")
    fits = lambda extent, total: F.floor(F.coalesce(F.try_divide(4 * n * extent, total), F.lit(1.0)))
    bounds = [F.min(F.least("x1", "x2")).alias("min_x"), F.max(F.greatest("x1", "x2")).alias("max_x"), F.min(F.least("y1", "y2")).alias("min_y"), F.max(F.greatest("y1", "y2")).alias("max_y")]
    one = edges.groupBy("zone_id", "ring").agg(*bounds, n.alias("n"), F.greatest(F.lit(1), F.least(F.ceil(n / 4), fits(high, F.sum(F.abs(F.col("y2") - F.col("y1")))))).alias("n_rows"), fits(wide, F.sum(F.abs(F.col("x2") - F.col("x1")))).alias("_c"))
    return one.withColumn("n_cols", F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(F.col("n") / F.col("n_rows")), F.col("_c")))).drop("_c")


def _step(value: Column, low: str, high: str, steps: str) -> Column:
    """The row or column of a value within the bounds; it never falls as the value rises, which is all that the cells rely on."""
    per = F.coalesce(F.try_divide(F.col(steps), F.col(high) - F.col(low)), F.lit(0.0))
    return F.least(F.floor((value - F.col(low)) * per), F.col(steps) - 1).cast("int")


def ring_cells(edges: DataFrame, ring: DataFrame) -> DataFrame:
    """zone_id, ring, row, col, edges, odd: what a point in that cell of the ring's grid has to be tested against.

    An edge that goes through the whole height of a row and lies right of a cell is crossed from any point of it, so those are counted
    beforehand: odd says whether their number is. Only edges near the cell, and those right of it that begin or end in its row, are kept
    with it. Cells without edges answer by themselves; those that lie outside are left out.
    """
    row, col = lambda y: _step(y, "min_y", "max_y", "n_rows"), lambda x: _step(x, "min_x", "max_x", "n_cols")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.where("y1 <> y2").join(ring, ["zone_id", "ring"]).select("zone_id", "ring", F.struct("x1", "y1", "x2", "y2").alias("edge"), row(low).alias("r1"), row(high).alias("r2"), (col(F.least("x1", "x2")) - 1).alias("c1"), (col(F.greatest("x1", "x2")) + 1).alias("c2"), "n_cols")
    e = e.select("*", F.explode(F.sequence("r1", "r2")).alias("row")).withColumn("whole", (F.col("row") > F.col("r1")) & (F.col("row") < F.col("r2")))
    first, last = F.when(F.col("whole"), F.greatest("c1", F.lit(0))).otherwise(0), F.least(F.col("c2"), F.col("n_cols").cast("int") - 1)
    kept = e.select("zone_id", "ring", "row", F.explode(F.sequence(first, last)).alias("col"), "edge", F.lit(0).alias("passed"))
    passed = e.where("whole AND c1 > 0").select("zone_id", "ring", "row", (F.col("c1") - 1).alias("col"), F.lit(None).cast(e.schema["edge"].dataType).alias("edge"), F.lit(1).alias("passed"))
    each = ring.select("zone_id", "ring", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows").cast("int") - 1)).alias("row")).select("zone_id", "ring", "row", F.explode(F.sequence(F.lit(0), F.col("n_cols").cast("int") - 1)).alias("col"), F.lit(None).cast(e.schema["edge"].dataType).alias("edge"), F.lit(0).alias("passed"))
    cells = kept.unionAll(passed).unionAll(each).groupBy("zone_id", "ring", "row", "col").agg(F.collect_list("edge").alias("edges"), F.sum("passed").alias("passed"))
    right = Window.partitionBy("zone_id", "ring", "row").orderBy(F.desc("col"))
    return cells.withColumn("odd", F.sum("passed").over(right) % 2).drop("passed").where("odd = 1 OR size(edges) > 0")


def point_in_polygon(points: DataFrame, edges: DataFrame, cell: float = 1.0) -> DataFrame:
    """point_id, zone_id of the first zone (lowest id) of which a ring holds the point; null if none does. Any ring counts, holes too.

    Points meet rings by the cells of a common grid that the rings' bounds touch, then the one cell of the ring's own grid in which they lie
    (`ring_cells`). Both joins are equalities. A ring is an ordered round of edges; it may have any number of them.
    """
    at = lambda c: F.floor(c / F.lit(cell)).cast("long")
    ring = rings(edges)
    near = ring.select("*", F.explode(F.sequence(at(F.col("min_x")), at(F.col("max_x")))).alias("cx")).select("*", F.explode(F.sequence(at(F.col("min_y")), at(F.col("max_y")))).alias("cy"))
    p = points.select("point_id", "lng", "lat", at(F.col("lng")).alias("cx"), at(F.col("lat")).alias("cy"))
    x, y = F.col("lng"), F.col("lat")
    met = p.join(near, ["cx", "cy"]).where((x >= F.col("min_x")) & (x <= F.col("max_x")) & (y >= F.col("min_y")) & (y <= F.col("max_y")))
    met = met.select("point_id", "lng", "lat", "zone_id", "ring", _step(y, "min_y", "max_y", "n_rows").alias("row"), _step(x, "min_x", "max_x", "n_cols").alias("col"))
    crosses = lambda e: F.when((e["y1"] > y) != (e["y2"] > y), (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]).cast("int")).otherwise(0)
    held = F.aggregate("edges", F.col("odd").cast("int"), lambda n, e: n + crosses(e)) % 2 == 1
    found = met.join(ring_cells(edges, ring), ["zone_id", "ring", "row", "col"]).where(held).groupBy("point_id").agg(F.min("zone_id").alias("zone_id"))
    return points.select("point_id").join(found, "point_id", "left")


def ring_areas(edges: DataFrame) -> DataFrame:
    """Per ring the signed area and centroid by the shoelace sums."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    got = edges.groupBy("zone_id", "ring").agg(F.sum(cross).alias("a2"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    return got.select("zone_id", "ring", (F.col("a2") / 2).alias("area"), (F.col("sx") / (3 * F.col("a2"))).alias("lng"), (F.col("sy") / (3 * F.col("a2"))).alias("lat"))


def zone_centroids(edges: DataFrame) -> DataFrame:
    """The centroid of each zone's largest ring (the first among equals)."""
    best = F.max_by(F.struct("lat", "lng", F.abs("area").alias("area")), F.struct(F.abs("area"), -F.col("ring")))
    return ring_areas(edges).groupBy("zone_id").agg(best.alias("c")).select("zone_id", "c.lat", "c.lng", "c.area")


def zones_within(zones: DataFrame, km: float) -> DataFrame:
    """a, b, km for the pairs of zones within km, a zone with itself included. They meet by the cells of a grid on the sphere, each about as wide as km."""
    a = zones.select(F.col("zone_id").alias("a"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), near_cells(F.col("lat"), F.col("lng"), km, False).alias("cell"))
    b = zones.select(F.col("zone_id").alias("b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"), F.explode(near_cells(F.col("lat"), F.col("lng"), km, True)).alias("cell"))
    return a.join(b, "cell").select("a", "b", distance("lat_a", "lng_a", "lat_b", "lng_b").alias("km")).where(F.col("km") <= km)


def distance(lat1: str, lng1: str, lat2: str, lng2: str) -> Column:
    return haversine_km(F.col(lat1), F.col(lng1), F.col(lat2), F.col(lng2))


def simplified(edges: DataFrame, tolerance: float) -> DataFrame:
    """Corners of each ring that stay when no corner may be further than tolerance from the drawn line: zone_id, ring, seq, x, y. A ring is one group."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        keep = simplify(np.vstack([g[["x1", "y1"]].to_numpy(), g[["x2", "y2"]].to_numpy()[-1:]]), tolerance)[:-1]
        return g[keep].rename(columns={"x1": "x", "y1": "y"})[["zone_id", "ring", "seq", "x", "y"]]

    kind = edges.schema["zone_id"].dataType.simpleString()
    return edges.groupBy("zone_id", "ring").applyInPandas(one, f"zone_id {kind}, ring int, seq int, x double, y double")
