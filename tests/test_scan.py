"""The spatial scan against plain versions: neighbours of all pairs, ratios by a dense matrix, clusters one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewright.functions.kernels import replication
from zonewright.operators import geo, scan

SCHEMA = "zone_id int, lat double, lng double, population long, cases long"


def places(n, seed, lats=(-5, 5), lngs=(33, 43)):
    r = random.Random(seed)
    return [(3 * k + 1, r.uniform(*lats), r.uniform(*lngs), r.randrange(100, 5000), r.randrange(0, 9)) for k in range(n)]


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("lats,lngs", [((-5, 5), (33, 43)), ((80, 90), (-180, 180)), ((-60, -50), (175, 180))])
def test_neighbours_equal_all_pairs(spark, lats, lngs):
    rows = places(80, 2, lats, lngs) + [(1000, float(lats[0]), -180.0, 1, 0), (1001, float(lats[0]), 180.0, 1, 0)]
    got = {(r.a, r.b) for r in geo.zones_within(spark.createDataFrame(rows, SCHEMA), 280).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if km(a, b) <= 280}
    unsure = {(a[0], b[0]) for a in rows for b in rows if abs(km(a, b) - 280) < 0.5}  # another radius of the earth's decimals
    assert got - unsure == want - unsure and len(got) >= len(rows)


def test_maxima_equal_a_dense_matrix(spark):
    rows = places(60, 7)
    z = spark.createDataFrame(rows, SCHEMA)
    ring = scan.circles(z)
    total = sum(r[4] for r in rows)
    people = np.array([r[3] for r in rows], dtype=float)
    at = {r[0]: k for k, r in enumerate(rows)}
    member = np.zeros((ring.count(), len(rows)))
    for i, r in enumerate(ring.collect()):
        member[i, [at[m] for m in r.members]] = 1
    expected = member @ people / people.sum() * total
    want = []
    for rep in range(99):
        o = member @ replication(424242, rep).multinomial(total, people / people.sum())
        over = o > expected
        want.append(float((o[over] * np.log(o[over] / expected[over])).max()) if over.any() else 0.0)
    one = {r.rep: r.llr for r in scan.null_maxima(z, ring, total, 99).collect()}
    many = {r.rep: r.llr for r in scan.null_maxima(z, ring, total, 99, members_per_task=50, numbers_at_once=700).collect()}
    assert np.allclose([one[k] for k in range(99)], want) and np.allclose([many[k] for k in range(99)], want)
    assert scan.null_maxima(z, ring.limit(0), total, 9).count() == 0


def test_clusters_one_by_one(spark):
    rows = [(k, lat, lng, p, 60 if k in (1, 4) else c) for k, lat, lng, p, c in places(50, 11)]
    z = spark.createDataFrame(rows, SCHEMA)
    found = sorted(scan.scanned(z.drop("cases"), z.select("zone_id", "cases")).collect(), key=lambda r: (-r.llr, r.center, r.radius_km))
    want, used = [], set()
    for c in found:
        if len(want) <= 2 and c.llr > 0 and not used & set(c.members):
            want.append((c.center, c.radius_km))
            used |= set(c.members)
    got = scan.clusters(z.drop("cases"), z.select("zone_id", "cases"), replications=19, level=1.0).orderBy("rank").collect()
    assert [(r.center, r.radius_km) for r in got] == want and len(want) == 3
    none = z.withColumn("cases", F.lit(0).cast("long"))
    assert scan.clusters(none.drop("cases"), none.select("zone_id", "cases"), replications=9).count() == 0


def test_many_zones(spark):
    """5,000 zones: pairs formed are near the pairs kept, and the hot zone is found, its circles being dealt to many tasks."""
    rows = places(5000, 3, (-40, 40), (-60, 60))
    rows[17] = (*rows[17][:4], 400)
    z = spark.createDataFrame(rows, SCHEMA)
    got = scan.clusters(z.drop("cases"), z.select("zone_id", "cases"), replications=19)
    first = got.where("rank = 0").first()
    assert rows[17][0] in first.members and first.p == 1 / 20
