"""Queries that SQL does not state, against second versions without Spark."""

import datetime
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from zonewright.functions import kernels
from zonewright.operators import capture, entity, forecast, news, rates
from zonewright.plans import catalogue
from zonewright.streaming import streams

from .test_kernels import plain_jaro_winkler


def records(n, seed=1):
    draw = random.Random(seed)
    words = ["amina", "otieno", "wanjiru", "kamau", "njeri", "hassan", "chebet", "mwangi"]
    out = []
    for k in range(n):
        name = " ".join(draw.choice(words) for _ in range(2))
        if draw.random() < 0.4:
            at = draw.randrange(len(name))
            name = name[:at] + draw.choice("xyz") + name[at + 1 :]
        out.append((k, draw.randrange(40), None if draw.random() < 0.05 else name, draw.choice(["a", "b"])))
    return out


SCHEMA = "record_id int, day_no int, name string, county string"


def plain_pairs(a, b, days, similarity):
    out = {}
    for i, di, ni, ci in a:
        for j, dj, nj, cj in b:
            if abs(di - dj) > days or ni is None or nj is None or (w := plain_jaro_winkler(ni, nj)) < similarity:
                continue
            s = 0.5 * w + 0.15 + 0.2 * (1 - abs(di - dj) / (days + 1))
            out[i, j] = np.floor(min(1, s + 0.05 * (ci == cj)) * 1000 + 0.5) / 1000
    return out


def plain_greedy(pairs):
    used_a, used_b, out = set(), set(), set()
    for (i, j), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if i not in used_a and j not in used_b:
            out.add((i, j))
            used_a.add(i)
            used_b.add(j)
    return out


def test_pairs_assignment_merge_and_patterns(spark):
    a, b = records(80, 1), [(1000 + k, *r) for k, *r in records(90, 2)]
    fa, fb = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    want = plain_pairs(a, b, 3, 0.82)
    scored = entity.checkpointed(entity.scored_pairs(fa, fb, 3, 0.82))
    assert {(r.a_id, r.b_id): r.score for r in scored.collect()} == pytest.approx(want)
    taken = plain_greedy(want)
    assigned = entity.checkpointed(entity.greedy_assignment(scored))
    assert {(r.a_id, r.b_id) for r in assigned.collect()} == taken
    assert {r.record_id for r in entity.unmatched(fa, assigned, "a_id").collect()} == {r[0] for r in a} - {i for i, _ in taken}
    merged = Counter((r.in_a, r.in_b) for r in entity.merged(fa, fb, assigned).collect())
    assert merged == {(True, True): len(taken), (True, False): len(a) - len(taken), (False, True): len(b) - len(taken)}
    both = [(*r[:3], r[3], r[0] % 3) for r in records(120, 3)]
    links = plain_pairs([r[:4] for r in both], [r[:4] for r in both], 2, 0.88)
    root = list(range(len(both)))
    for (i, j), _ in links.items():
        if i < j:
            root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    lists = defaultdict(set)
    for r in both:
        lists[root[r[0]]].add(r[4])
    patterns = Counter("+".join(map(str, sorted(v))) for v in lists.values())
    got = entity.capture_patterns(spark.createDataFrame(both, SCHEMA + ", list_no int"))
    assert {r.pattern: r.n for r in got.collect()} == patterns and sum(patterns.values()) == len(set(root))


def test_pairs_by_items_lose_none(spark):
    draw = random.Random(4)
    rows = [(k, draw.randrange(6), draw.choice("xy"), sorted(draw.sample(range(30), draw.randrange(1, 12)))) for k in range(150)]
    df = spark.createDataFrame([(k, d, s, [str(x) for x in w]) for k, d, s, w in rows], "id int, day int, src string, w array<string>")
    from pyspark.sql import functions as F

    n = F.size("w")
    got = {(r.a, r.b) for r in entity.pairs_by_items(df, "id", "w", n - F.ceil(0.5 * n) + 1, "day", 1, ["src"]).collect()}
    want = {(i, j) for i, di, si, wi in rows for j, dj, sj, wj in rows if i < j and abs(di - dj) <= 1 and si == sj and 2 * len(set(wi) & set(wj)) >= len(set(wi) | set(wj))}
    assert want <= got


def test_sums_below(spark):
    v = [(k * 7919 % 1000 / 10, k % 5 + 1) for k in range(1000)]
    got = {r.v: r.below for r in rates.sums_below(spark.createDataFrame(v, "v double, n long").repartition(5), "v", "n", "below").collect()}
    total = 0
    for x, n in sorted(v):
        assert got[x] == total
        total += n


def test_person_names():
    # words, then what the rule gives: runs of capitalised words that are no stop words, scored by length and neighbours
    for title, name in (("Activist Jane Wanjiru Missing after protest", "Jane Wanjiru"), ("Peter Kimani Otieno Baraka Juma spoke to Mary Atieno", "Peter Kimani Otieno Baraka Juma"), ("Kenya Police", None), ("Anne Njoki met editor Paul Musyoka dumped", "Paul Musyoka"), ("", None), ("One", None)):
        assert news._best_name(title) == name, title


def test_simulated_intervals(spark, sf):
    r = catalogue.chapman_bootstrap(spark, sf).first()
    again = catalogue.chapman_bootstrap(spark, sf).first()
    assert r == again and r.low < r.high and r.method == "chapman-2list"
    m = catalogue.mse_three_lists(spark, sf).first()
    assert m.documented <= m.low < m.high and m.low <= m.estimated <= m.high
    draws = [kernels.replication(5, k).multinomial(1000, [0.2, 0.8])[0] for k in range(400)]
    assert abs(np.mean(draws) - 200) < 3 and abs(np.std(draws) - np.sqrt(160)) < 2 and len(set(draws)) > 30


def test_coverage_bars(spark):
    rng = np.random.default_rng(7)
    rows = [(f"{2015 + k // 12}-{k % 12 + 1:02d}", int(v)) for k, v in enumerate(rng.poisson(20, 60))]
    errors = forecast.one_step_errors(spark.createDataFrame(rows, "month string, n long"), "n", 12)
    s = forecast.error_summary(errors).first()
    assert s.n == 48 and 0.85 <= s.coverage <= 1 and s.mae < 8


def test_calibration_climbs():
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"a": rng.random(60), "b": rng.random(60), "fold": np.arange(60) % 2})
    rows["outcome"] = (rows.b * 4).astype(int)
    best, top = forecast.calibrate_weights(rows, {"a": 0.9, "b": 0.1})
    folds = [(g[["a", "b"]].to_numpy(), g.outcome.to_numpy(float)) for _, g in rows.groupby("fold")]
    assert best["b"] > 0.6 and abs(sum(best.values()) - 1) < 1e-9 and top > forecast.ranking_score(folds, np.array([0.9, 0.1]))


def test_rate_limit_is_the_recurrence(spark):
    draw = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=draw.randrange(4000)), draw.choice("ab")) for k in range(200)]
    got = {r.request_id: r.allowed for r in streams.rate_limited(spark.createDataFrame(rows, "request_id int, ts timestamp, k string"), "k", limit=3, seconds=60).collect()}
    held = defaultdict(list)
    for i, t, k in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        recent = [x for x in held[k] if (t - x).total_seconds() < 60]
        assert got[i] == (len(recent) < 3)
        held[k] = recent + [t] * (len(recent) < 3)


def test_case_states_of_a_stream(spark, sf):
    e = pd.read_parquet(f"{sf}/events.parquet").sort_values("event_id")
    got = {r.case_id: (r.status, r.updates) for r in catalogue.stream_case_state(spark, sf).collect()}
    assert set(got) == {f"case-{u}" for u in e.user_id % 50}
    for user, g in e.groupby(e.user_id % 50):
        decided = np.flatnonzero(g.event_id % 900 == 899)
        if not len(decided):
            assert got[f"case-{user}"] == ("ready" if len(set(g.event_id % 7)) >= 2 else "pending", len(g))


def test_risk_classifier_learns(spark, sf):
    got = {r.feature: r for r in catalogue.risk_classifier(spark, sf).collect()}
    assert len(got) == 7 and all(np.isfinite(r.weight) and r.sd > 0 for r in got.values())


def test_three_lists_of_flags(spark):
    from pyspark.sql import functions as F

    df = spark.range(200).select(*((F.col("id") % k == 0).alias(f"f{k}") for k in (2, 3, 5))).where("f2 OR f3 OR f5")
    r = capture.three_list_estimate(df, [F.col("f2"), F.col("f3"), F.col("f5")], replications=50)
    assert r["documented"] == sum(k % 2 == 0 or k % 3 == 0 or k % 5 == 0 for k in range(200)) and r["low"] <= r["estimated"] <= r["high"] + 60
