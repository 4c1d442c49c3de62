"""The forecast as a whole, the analysis document, the digest and the brief, held against plain Python and hand-written lines."""

import json
import math

import pytest
from pyspark.sql import functions as F

from zonewright.functions.kernels import poisson_gamma
from zonewright.operators import entity, forecast, reports, sinks
from zonewright.plans import catalogue, reporting

GRID = "zone_id int, month string, mi int, events long, present boolean"


def months(n):
    return [f"{2000 + k // 12}-{k % 12 + 1:02d}" for k in range(n)]


def expected(rows, top=8):
    """The report's rows by level and key, from (zone, month, mi, events, present)."""
    names = sorted({r[1] for r in rows})
    total = [float(sum(r[3] for r in rows if r[1] == m)) for m in names]
    start = min(12, max(4, len(names) // 3))
    errors, inside = [], 0
    for k in range(start, len(names)):
        mean, low, high = poisson_gamma(total[:k], 1)[0]
        errors.append(mean - total[k])
        inside += low <= total[k] <= high
    n = len(errors)
    out = {("national", k + 1): (*v, sum(map(abs, errors)) / n if n else 0.0, math.sqrt(sum(e * e for e in errors) / n) if n else 0.0, inside / n if n else 0.0, n) for k, v in enumerate(poisson_gamma(total, 3))}
    zones = {}
    for z in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == z), key=lambda r: r[2])
        if sum(r[4] for r in own) >= 6:
            zones[z] = tuple(poisson_gamma([float(r[3]) for r in own], 1)[0])
    return out | {("zone", z): zones[z] for z in sorted(zones, key=lambda z: (-zones[z][0], z))[:top]}


def check(df, rows):
    want, got = expected(rows), {(r.level, r.step if r.level == "national" else r.zone_id): r for r in df.collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        have = (r["mean"], r.lower95, r.upper95) + ((r.mae, r.rmse, r.coverage, r.n) if r.level == "national" else ())
        assert have == pytest.approx(want[key], rel=1e-9)
    return got


def test_forecast_report(spark):
    rows = [(z, m, k, (k * 7 + z * 5) % 11 + z, z != 3 or k < 5) for z in range(12) for k, m in enumerate(months(26))]
    got = check(forecast.forecast_report(spark.createDataFrame(rows, GRID)), rows)
    assert [got["national", k].month for k in (1, 2, 3)] == ["2002-03", "2002-04", "2002-05"]
    assert ("zone", 3) not in got and sum(k[0] == "zone" for k in got) == 8
    assert all(r.month == "2002-03" and r.step == 1 and r.n is None for k, r in got.items() if k[0] == "zone")


@pytest.mark.parametrize("n", [1, 4, 5, 13])
def test_forecast_report_of_few_months(spark, n):
    rows = [(z, m, k, k + z, True) for z in (1, 2) for k, m in enumerate(months(n))]
    check(forecast.forecast_report(spark.createDataFrame(rows, GRID)), rows)


def test_forecast_report_of_nothing(spark):
    assert forecast.forecast_report(spark.createDataFrame([], GRID)).count() == 0


def test_registered_forecast_report(spark, sf):
    rows = [tuple(r) for r in catalogue.grid_filled(spark, sf).select("zone_id", "month", "mi", "events", "present").collect()]
    want = expected(rows)
    for r in catalogue.forecast_report(spark, sf).collect():
        v = want[r.level, r.step if r.level == "national" else r.zone_id]
        assert (r["mean"], r.lower95, r.upper95) == pytest.approx(v[:3], abs=1e-6)


def test_analysis_document(spark):
    zones = spark.createDataFrame([("b", 2, [1.5]), ("a", None, []), ("ä \"q\"", 1, None)], "zone string, n int, xs array<double>")
    doc = sinks.analysis_document({"zones": zones, "alerts": zones.where("n > 5"), "again": zones.select("n")})
    (row,) = doc.collect()
    assert json.loads(row.json) == {
        "zones": [{"zone": "a", "xs": []}, {"zone": "b", "n": 2, "xs": [1.5]}, {"zone": "ä \"q\"", "n": 1}],
        "alerts": [],
        "again": [{}, {"n": 1}, {"n": 2}],
    }
    read = sinks.document_part(doc, "zones", "zone string, n int")
    assert [tuple(r) for r in read.orderBy("place").collect()] == [(0, "a", None), (1, "b", 2), (2, "ä \"q\"", 1)]
    assert sinks.document_part(doc, "alerts", "zone string").count() == 0


def test_pattern_order(spark):
    names = ["0+1+2", "1", "0+2", "0", "0+1", ""]
    got = entity.in_pattern_order(spark.createDataFrame([(x, 1) for x in names], "pattern string, n int")).orderBy("place").collect()
    assert [r.pattern for r in got] == ["", "0", "1", "0+1", "0+2", "0+1+2"]


QUEUE = [
    # case_id, status, hint, corroboration, latest_pub_date, promoted_on
    (1, "ready", "one", 2, "2001-08-01", None),
    (2, "ready", None, 3, "2001-08-01", None),
    (3, "ready", "three", 2, None, None),
    (4, "promoted", "four", 4, "2001-07-01", "2001-07-26"),
    (5, "promoted", "five", 4, "2001-07-01", "2001-07-25"),
    (6, "promoted", "six", 4, "2001-07-01", "2001-08-03"),
    (7, "pending", "seven", 1, "2001-07-24", None),
    (8, "pending", "eight", 1, "2001-07-23", None),
    (9, "duplicate", "nine", 1, "2001-08-02", None),
]
ZONE = "zone_id int, zone_name string, index double, band string, abductions long, vac_events long"


def parts(spark, zones, days, patterns=(), alerts=(), estimate=(3, 4, 0, None, None)):
    day = spark.createDataFrame(days, "zone_id int, in_mv boolean, in_ob boolean, n long")
    e = spark.createDataFrame([estimate], "n_a long, n_b long, overlap long, chapman double, factor double").withColumn("documented", F.lit(7).cast("long"))
    raised = spark.createDataFrame(list(alerts), "place int, severity string, title string")
    seen = spark.createDataFrame(list(patterns), "vehicle_key string, status string")
    return reports.overview(spark.createDataFrame(zones, ZONE), day, e, seen, raised), raised


def digest(spark, now, raised, previous=(), spikes=(), statements=20, queue=()):
    before = spark.createDataFrame(list(previous), "documented long, abductions long, statements long")
    flags = spark.createDataFrame(list(spikes), "month string, ed long, baseline double, z double, flagged boolean")
    news = spark.createDataFrame([(5, 9, 1.25, statements)], "last7d long, last30d long, weekly_baseline double, statements long")
    q = spark.createDataFrame(list(queue), "case_id long, status string, hint string, corroboration long, latest_pub_date string, promoted_on string")
    q = q.withColumns({c: F.to_date(c) for c in ("latest_pub_date", "promoted_on")})
    lines = reports.weekly_digest(now, before, flags, news, q, raised, F.lit(-3), F.lit("2001-08-02").cast("date"))
    got: dict[str, list[str]] = {}
    for r in sorted(lines.collect(), key=lambda r: (r.section, r.place)):
        got.setdefault(r.section, []).append(r.line)
    return got, lines


def test_overview_of_nothing(spark):
    now, raised = parts(spark, [], [])
    (r,) = now.collect()
    assert (r.documented, r.located, r.capture_a, r.highest_zone, r.highest_index, r.abductions, r.patterns, r.alerts, r.estimable) == (0, 0, 0.0, "-", 0.0, 0, 0, 0, False)
    got, _ = digest(spark, now, raised)
    assert got["moved"][-1] == "- First digest: nothing to compare with." and got["queue"][-1] == "- Nothing is ready." and got["alerts"] == ["- None at action level."]
    assert got["numbers"][1] == "- No estimate: the lists share 0 records." and len(got["numbers"]) == 4 and got["clock"] == ["0 months to the next election."]


def test_digest_lines(spark):
    zones = [(2, "B", 61.5, "elevated", 4, 6), (1, "A", 61.5, "elevated", None, 1), (3, None, 80.0, "critical", 0, 0), (4, "D", 10.0, "baseline", 0, 0)]
    days = [(1, True, False, 5), (None, True, True, 2), (1, False, False, 9), (2, False, True, 1)]
    alerts = [(k, "critical" if k <= 21 else "info", f"t{k}") for k in range(1, 31)]
    now, raised = parts(spark, zones, days, [("v", "flagged"), ("w", "monitoring")], alerts, (7, 3, 3, 9.5, 1.357))
    (r,) = now.collect()
    assert (r.documented, r.located, r.unlocated, r.capture_a, r.capture_b) == (8, 6, 2, 87.5, 37.5)
    assert (r.estimated, r.factor, r.zones, r.critical, r.elevated, r.watch, r.highest_index, r.abductions, r.vac_events) == (10, 1.36, 4, 1, 2, 0, 80.0, 4, 7)
    assert (r.patterns, r.flagged_patterns, r.alerts, r.active_alerts) == (2, 1, 30, 21)
    spikes = [("2001-06", 9, 2.0, 3.0, True), ("2001-05", 8, 2.04, 3.0, True), ("2001-07", 99, 2.0, 9.0, False)]
    got, lines = digest(spark, now, raised, [(10, 4, 20)], spikes, 20, QUEUE)
    assert got["numbers"][0] == "- **8 incidents on record** (-2 since the last digest), 6 of them with a place."
    assert got["numbers"][3] == "- Weekly aggregates of twelve months: 4 abductions, 7 attacks on civilians."
    assert got["numbers"][4] == "- 2001-05 stands out: 8 cases, 2.0 a month before (z 3.0)."  # equal z: the earlier month
    assert got["moved"][1:] == ["- No new statement after number 20.", "- Moved: incidents 10 -> 8."]
    assert got["queue"][0].startswith("Promoted so far: 3, held out as already known: 1, waiting for a second source: 2.") and "**3 ready**" in got["queue"][1]
    assert got["queue"][2:] == ["- ready: one (2 outlets, 2001-08-01)", "- ready:  (3 outlets, 2001-08-01)", "- ready: three (2 outlets, )", "- promoted: four (4 outlets, 2001-07-01)", "- lead: seven (1 outlets, 2001-07-24)"]
    assert got["alerts"] == [f"- **CRITICAL** t{k}" for k in range(1, 21)]
    (text,) = (x.text for x in reports.as_markdown(lines, "T").collect())
    assert text.startswith("# T\n\n## The numbers\n\n- **8 incidents") and text.index("## What moved") < text.index("## The curators' queue") < text.index("## Alerts to act on") < text.index("## The election clock")
    assert digest(spark, now, raised, [(8, 4, 18)], (), 20)[0]["moved"][1:] == ["- 2 new statements, up to number 20.", "- Moved: statements 18 -> 20."]
    assert digest(spark, now, raised, [(8, 4, 20)], (), 20)[0]["moved"][2] == "- No total moved."


def test_brief_with_clusters_and_forecast(spark, sf):
    rows = reporting.analysis_brief_significant(spark, sf).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.section, r.place)):
        by.setdefault(r.section, []).append(r.line)
        assert r.line is not None
    assert [r.place for r in sorted((r for r in rows if r.section == "zones"), key=lambda r: r.place)] == list(range(25)) and len(by["forecast"]) == 3
    found = [c for c in catalogue.found_clusters(catalogue.Basis(spark, sf)).collect() if c.p <= 0.05]
    assert len(by["clusters"]) == max(1, len(found)) and (by["clusters"] == ["No cluster."]) == (not found)
    ahead = sorted((r for r in catalogue.forecast_report(spark, sf).collect() if r.level == "national"), key=lambda r: r.month)
    assert [x.split(":")[0] for x in by["forecast"]] == [r.month for r in ahead]
