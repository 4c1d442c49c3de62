"""Folds as of a cutoff: nothing later reaches a component; reports and calibration against plain Python."""

import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonewright.operators import folds, forecast, risk, vehicles
from zonewright.plans import catalogue
from zonewright.sources import tables as src

D = datetime.date


def parts(spark, sf, incidents, weekly, simulated=False):
    seen = vehicles.best_windows(src.sightings(spark, sf), 3).where("n >= 6").select(F.explode("zones").alias("zone_id"))
    got = folds.components(src.zones(spark, sf), incidents, weekly, seen, catalogue.FOLDS, catalogue.HISTORY_FROM, simulated)
    return {(r.fold, r.zone_id): (tuple(r[k] for k in risk.WEIGHTS), r.outcome) for r in got.collect()}


def test_later_incidents_change_no_component(spark, sf):
    incidents, weekly = src.incidents(spark, sf), src.weekly(spark, sf)
    plain = parts(spark, sf, incidents, weekly)
    more = incidents.where("zone_id IS NOT NULL").select("incident_id", F.lit(D(2001, 1, 2)).alias("incident_date"), F.lit(3).alias("zone_id"), "in_mv", "in_ob", F.lit(True).alias("in_mort"))
    other = incidents.where(F.col("incident_date") <= D(2001, 1, 1)).unionByName(more)
    late = weekly.withColumn("events", F.when(F.col("week") > D(2001, 1, 1), F.col("events") * 1000).otherwise(F.col("events")))
    got = parts(spark, sf, other, late)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in plain.items()} and len(got) == 50
    assert got[0, 3][1] == more.count() and all(got[0, z][1] == 0 for z in range(25) if z != 3)
    # what lies between the cutoffs is known to the first fold alone
    between = incidents.where(~F.col("incident_date").between(D(2000, 7, 2), D(2001, 1, 1)))
    got = parts(spark, sf, between, weekly)
    assert {k: v[0] for k, v in got.items() if k[0] == 1} == {k: v[0] for k, v in plain.items() if k[0] == 1}
    assert {k: v[0] for k, v in got.items() if k[0] == 0} != {k: v[0] for k, v in plain.items() if k[0] == 0}


def test_counts_at_the_edges(spark):
    fold = folds.Fold(7, D(2020, 1, 1), D(2020, 12, 31), D(2021, 6, 30))
    days = [D(2019, 12, 31), D(2020, 1, 1), D(2020, 10, 2), D(2020, 10, 1), D(2020, 12, 30), D(2020, 12, 31), D(2021, 1, 1), D(2021, 6, 30), D(2021, 7, 1), D(2018, 5, 5)]
    rows = [(d, 1, True, k % 2 == 0, True) for k, d in enumerate(days)] + [(D(2020, 5, 5), None, True, True, False)]
    got = {r.zone_id: r for r in folds.known_counts(spark.createDataFrame(rows, "incident_date date, zone_id int, in_mv boolean, in_ob boolean, in_mort boolean"), [fold], D(2019, 1, 1)).collect()}
    r = got[1]
    assert (r.documented, r.outcome, r.deaths, r.b0, r.b1, r.fold) == (5, 2, 6, 2, 1, 7)
    assert (got[None].documented, got[None].n_ab, r.n_a) == (1, 1, 5)


def test_simulated_clusters_of_each_fold(spark, sf):
    zones, cases = src.zones(spark, sf), spark.createDataFrame([(f, z, 40 if z == f + 3 else 2) for f in (0, 1) for z in range(25)], "fold int, zone_id int, cases long")
    got = folds.found_circles(zones, cases, catalogue.FOLDS, 99).collect()
    assert {0, 1} == {r.fold for r in got} and {(0, 3), (1, 4)} <= {(r.fold, r.zone_id) for r in got}
    assert len(got) == len({(r.fold, r.zone_id) for r in got})


def ranks(x):
    return [sum(v < w for v in x) + (sum(v == w for v in x) + 1) / 2 for w in x]


def test_report(spark):
    draw = np.random.default_rng(1)
    rows = [(f, *(round(float(v), 2) for v in draw.random(len(risk.WEIGHTS))), int(draw.integers(0, 3)) if f else 1) for f in (0, 1) for _ in range(30)]
    df = spark.createDataFrame(rows, "fold int, " + ", ".join(f"{k} double" for k in risk.WEIGHTS) + ", outcome long")
    got = {(r.weights, r.fold): r for r in folds.ranking_report(df, catalogue.WEIGHT_SETS).collect()}
    for (name, weights), f in itertools.product(catalogue.WEIGHT_SETS.items(), (0, 1)):
        own = [r for r in rows if r[0] == f]
        score = [np.floor(sum(w * v for w, v in zip(weights.values(), r[1:-1], strict=True)) * 1e6 + 0.5) / 1e6 for r in own]
        wins = [(s > t) + (s == t) / 2 for s, a in zip(score, own, strict=True) for t, b in zip(score, own, strict=True) if a[-1] >= 1 and b[-1] < 1]
        r = got[name, f]
        assert r.auc == pytest.approx(sum(wins) / len(wins) if wins else 0.5) and r.n == 30
        rho = np.corrcoef(ranks(score), ranks([x[-1] for x in own]))[0, 1] if f else 0.0
        assert r.rho == pytest.approx(rho)


def test_calibration_reads_the_folds(spark, sf, monkeypatch):
    monkeypatch.setattr(catalogue, "fold_components", lambda spark, d, simulated=False, made=catalogue.fold_components: made(spark, d))
    rows = pd.DataFrame([(f, z, *v, o) for (f, z), (v, o) in parts(spark, sf, src.incidents(spark, sf), src.weekly(spark, sf)).items()], columns=["fold", "zone_id", *risk.WEIGHTS, "outcome"])

    def objective(weights):
        total = []
        for _, g in rows.groupby("fold"):
            score = list((g[list(weights)] * list(weights.values())).sum(axis=1))
            y = list(g["outcome"])
            wins = [(s > t) + (s == t) / 2 for s, a in zip(score, y, strict=True) for t, b in zip(score, y, strict=True) if a >= 1 and b < 1]
            a, b = ranks(score), ranks(y)
            rho = np.corrcoef(a, b)[0, 1] if len(set(a)) > 1 and len(set(b)) > 1 else 0.0
            total.append((sum(wins) / len(wins) if wins else 0.5) + abs(rho) / 2)
        return sum(total) / len(total)

    got = catalogue.calibrate_weights(spark, sf).collect()
    best = {r.component: r.weight for r in got}
    assert sum(best.values()) == pytest.approx(1) and min(best.values()) >= 0
    assert got[0].objective == pytest.approx(objective(best)) and got[0].objective >= objective(dict(risk.WEIGHTS)) - 1e-9


def test_gathered_is_bounded(spark):
    with pytest.raises(ValueError, match="more than 10"):
        forecast.gathered(spark.range(11), 10)
    assert len(forecast.gathered(spark.range(10), 10)) == 10
