"""Registered queries take every row of their tables: brute force over the smallest tables."""

import re
from collections import Counter

import pandas as pd

from zonewright.plans import catalogue


def incidents(sf):
    o = pd.read_parquet(f"{sf}/orders.parquet")
    o = o[o.o_orderpriority.isin(["1-URGENT", "2-HIGH"]) | (o.o_orderstatus == "F") | (o.o_orderkey % 7 == 0)]
    i = o.merge(pd.read_parquet(f"{sf}/customer.parquet"), left_on="o_custkey", right_on="c_custkey")
    return i[i.o_orderkey % 20 != 0]


def test_components_of_all_orders(spark, sf):
    o = pd.read_parquet(f"{sf}/orders.parquet")
    o["day"] = pd.to_datetime(o.o_orderdate).dt.floor("D")
    want = {}
    for _, g in o.sort_values(["day", "o_orderkey"]).groupby("o_custkey"):
        for _, c in g.groupby((g.day.diff() > pd.Timedelta(days=60)).cumsum()):
            want |= dict.fromkeys(c.o_orderkey, c.o_orderkey.min())
    got = {r.node: r.root for r in catalogue.connected_components(spark, sf).collect()}
    assert len(got) == len(o) and got == want


def test_centroids_of_all_located_incidents(spark, sf):
    want = Counter(incidents(sf).c_nationkey)
    got = catalogue.zone_centroids_min_support(spark, sf).collect()
    assert {r.zone_id: r.n for r in got if r.n} == want
    lat = incidents(sf).groupby("c_nationkey").o_orderkey.agg(lambda k: (k % 7 / 100).mean())
    assert all(abs(r.lat - (-4 + 0.85 * (r.zone_id % 5) + lat[r.zone_id])) < 2e-6 for r in got if r.n >= 2)


def test_grid_of_all_incidents(spark, sf):
    i = incidents(sf)
    month = pd.to_datetime(i.o_orderdate).dt.strftime("%Y-%m")
    want = Counter(zip(i.c_nationkey[month < "1999-01"], month[month < "1999-01"], strict=True))
    got = {(r.zone_id, r.month): r.events for r in catalogue.grid_filled(spark, sf).where("month < '1999-01' AND events > 0").collect()}
    assert got == want


def test_crossmatch_within_45_days(spark, sf):
    p = pd.read_parquet(f"{sf}/part.parquet").sort_values("p_partkey")
    r = [(k, k * 17 % 365, set(re.findall("[a-z']+", f"{n} {t}".lower()))) for k, n, t in zip(p.p_partkey, p.p_name, p.p_type, strict=True)]
    want = {}
    for c, day, w in (x for x in r if x[0] % 2):
        near = [k for k, d, v in r if k % 2 == 0 and abs(d - day) <= 45 and (2 * len(w & v) >= len(w | v) or (abs(d - day) <= 14 and c % 40 == 1 and k % 40 == 0))]
        if near:
            want[c] = near[0]
    assert {x.case_id: x.record_id for x in catalogue.record_crossmatch(spark, sf).collect()} == want
