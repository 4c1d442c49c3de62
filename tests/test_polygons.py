"""Points in polygons against the crossing rule over all edges, on outlines of many shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewright.operators import geo

SCHEMA = "zone_id int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def closed(corners, zone=0, ring=0):
    return [(zone, ring, k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True))]


def coast(n, seed, x=0.0, y=0.0, size=2.0):
    r = random.Random(seed)
    return [(x + size * (1 + 0.1 * math.sin(9 * t) + 0.01 * r.random()) * math.cos(t), y + size * (1 + 0.01 * r.random()) * math.sin(t)) for t in (2 * math.pi * k / n for k in range(n))]


def comb(n, upright=True):
    """Teeth over the whole height (or width), joined at the base."""
    teeth = [(4.0 * k / n, 3.0 if k % 2 else 1.0) for k in range(n)] + [(4.0, 0.0), (0.0, 0.0)]
    return teeth if upright else [(b, a) for a, b in teeth]


def plain(x, y, rows):
    e = np.array([r[3:] for r in rows])
    x1, y1, x2, y2 = e[e[:, 1] != e[:, 3]].T
    return np.array([np.count_nonzero(((y1 > b) != (y2 > b)) & (a < (x2 - x1) * (b - y1) / (y2 - y1) + x1)) % 2 == 1 for a, b in zip(x, y, strict=True)])


SHAPES = {
    "square": [(0, 0), (1, 0), (1, 1), (0, 1)],
    "triangle": [(0, 0), (2, 0.5), (1, 2)],
    "flat": [(0, 0), (2, 0), (1, 0)],
    "coast": coast(700, 1),
    "upright comb": comb(301),
    "level comb": comb(301, False),
    "crossing itself": [(random.Random(k).random(), random.Random(1000 + k).random()) for k in range(60)],
    "steps on a lattice": [(k // 2, (k + 1) // 2) for k in range(40)] + [(20, 0)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_the_rule_over_all_edges(spark, shape):
    rows = closed(SHAPES[shape])
    r = random.Random(5)
    xs, ys = [a for a, _ in SHAPES[shape]], [b for _, b in SHAPES[shape]]
    at = [(r.uniform(min(xs) - 0.2, max(xs) + 0.2), r.uniform(min(ys) - 0.2, max(ys) + 0.2)) for _ in range(600)]
    at += SHAPES[shape][:150] + [(a, r.choice(ys)) for a in xs[:150]]  # corners, and points level with corners
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)], "point_id int, lng double, lat double")
    got = {p.point_id: p.zone_id is not None for p in geo.point_in_polygon(points, spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain([a for a, _ in at], [b for _, b in at], rows)
    assert [got[k] for k in range(len(at))] == want.tolist()


def test_lowest_zone_any_ring_and_nulls(spark):
    rows = closed([(0, 0), (2, 0), (2, 2), (0, 2)], 7) + closed([(1, 1), (3, 1), (3, 3), (1, 3)], 4) + closed([(9, 9), (10, 9), (10, 10)], 4, 1)
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.5, 0.5), (3, 9.9, 9.5), (4, 8.0, 8.0), (5, None, 1.0), (1, 0.5, 0.5)], "point_id int, lng double, lat double")
    got = {p.point_id: p.zone_id for p in geo.point_in_polygon(points, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 4, 2: 7, 3: 4, 4: None, 5: None}
    assert geo.point_in_polygon(points, spark.createDataFrame([], SCHEMA)).where("zone_id IS NOT NULL").count() == 0
    assert geo.point_in_polygon(points.limit(0), spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_an_outline_of_many_edges(spark):
    """100,000 edges: cells hold few of them (an edge has 6 rows or fewer on average, two of them with 8 cells and the rest with 3), there are not many more cells and edges kept than edges, and points are placed as by all edges."""
    rows = closed(coast(100_000, 3))
    edges = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), SCHEMA).cache()
    cells = geo.ring_cells(edges, geo.rings(edges)).select(F.size("edges").alias("n"))
    most, total, count, inner = cells.agg(F.max("n"), F.sum("n"), F.count("*"), F.count_if(F.col("n") == 0)).first()
    assert total < 28 * len(rows) and count < len(rows) and inner > 0
    r = random.Random(8)
    at = [(r.uniform(-2.4, 2.4), r.uniform(-2.1, 2.1)) for _ in range(400)]
    assert most < 2500 and total / count < 200  # level stretches at the top and the bottom are the fullest: 1,793 measured
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "point_id int, lng double, lat double")
    got = {p.point_id: p.zone_id is not None for p in geo.point_in_polygon(points, edges).collect()}
    assert [got[k] for k in range(len(at))] == plain([a for a, _ in at], [b for _, b in at], rows).tolist()
    edges.unpersist()
