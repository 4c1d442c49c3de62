"""The index, the projections and the feed with simulated clusters, held against plain Python."""

import math

from zonewright.operators import risk, scan
from zonewright.plans import catalogue
from zonewright.sources import tables as src

WEIGHTS = (("eb_pct", 0.3), ("mse_pct", 0.16), ("cluster_score", 0.28), ("acled_recent", 0.1), ("temporal_score", 0.1), ("vehicle_score", 0.06))
SCHEMA = "rank int, center int, radius_km int, members array<int>, observed long, expected double, rr double, llr double, p double"
FOUND = [(0, 3, 80, [3, 4], 90, 30.0, 2.5, 40.0, 0.001), (1, 9, 40, [4, 9], 20, 9.0, 3.25, 8.0, 0.05), (2, 1, 40, [1], 7, 5.0, 9.0, 1.0, 0.051)]


def test_only_significant_clusters_count(spark):
    got = {r.zone_id: r.rr for r in risk.in_significant(spark.createDataFrame(FOUND, SCHEMA)).collect()}
    assert got == {3: 2.5, 4: 3.25, 9: 3.25}
    assert risk.in_significant(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_with_given_clusters(spark, sf):
    plain = {r.zone_id: r for r in catalogue.composite_index(spark, sf).collect()}
    inside = risk.in_significant(spark.createDataFrame(FOUND, SCHEMA))
    got = {r.zone_id: r for r in catalogue.index_table(spark, sf, inside).collect()}
    assert len(got) == len(plain) == 25
    rr = {3: 2.5, 4: 3.25, 9: 3.25}
    for zone, r in got.items():
        assert r.cluster_score == min(max((rr.get(zone, 1.0) - 1) / 3, 0), 1)
        parts = {k: plain[zone][k] for k, _ in WEIGHTS} | {"cluster_score": r.cluster_score}
        want = math.floor(sum(w * parts[k] for k, w in WEIGHTS) * 1000 + 0.5) / 10
        assert abs(r["index"] - want) < 0.1001  # parts are rounded to six places in the query
        assert any("rate ratio" in x for x in r.drivers) == (zone in rr)


def test_registered_index_follows_the_simulation(spark, sf):
    found = scan.clusters(src.zones(spark, sf), catalogue.zone_cases(spark, sf)).collect()
    rr = {}
    for c in found:
        if c.p <= 0.05:
            rr |= {z: max(c.rr, rr.get(z, 0.0)) for z in c.members}
    for r in catalogue.composite_index_significant(spark, sf).collect():
        assert abs(r.cluster_score - min(max((rr.get(r.zone_id, 1.0) - 1) / 3, 0), 1)) < 1e-6


def test_projection_by_the_forecast(spark, sf):
    index = {r.zone_id: r["index"] for r in catalogue.composite_index_significant(spark, sf).collect()}
    ahead = {r.zone_id: r for r in catalogue.forecast.forecast_zones(catalogue.grid(spark, sf)).collect()}
    got = catalogue.forecast_projection_top12(spark, sf).collect()
    assert {r.zone_id for r in got} == set(sorted(index, key=lambda z: (-index[z], z))[:12])
    for r in got:
        f = ahead.get(r.zone_id)
        trend = 1.0 if f is None else (1.4 if f["mean"] > 0 else 1.0) if f.recent3 <= 0 else min(max(f["mean"] / f.recent3, 0.5), 2.0)
        assert r.current_index == index[r.zone_id] and abs(r.trend - trend) < 0.00501
        assert abs(r.projected_index - min(max(index[r.zone_id] + 12 * (trend - 1), 0), 100)) < 0.0501


def test_feed_holds_cluster_alerts(spark, sf):
    found = spark.createDataFrame(FOUND, SCHEMA)
    alerts = risk.cluster_alerts(found, src.zones(spark, sf))
    got = catalogue.feed(spark, sf, risk.in_significant(found), alerts).orderBy("place").collect()
    clusters = [r for r in got if r.kind == "cluster"]
    assert len(clusters) == 2 and all(r.severity == "info" for r in clusters)
    assert [r.place for r in got] == list(range(1, len(got) + 1))
    rank = [risk.SEVERITIES.index(r.severity) for r in got]
    assert rank == sorted(rank)
    info = [r.kind for r in got if r.severity == "info"]
    assert info[:2] == ["cluster", "cluster"]
