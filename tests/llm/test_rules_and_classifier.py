import re
import zlib
from collections import Counter

import numpy as np

from zonewright.llm import quality_classifier as qc
from zonewright.llm import quality_rules as qr
from zonewright.llm.common import table

from .helpers import awkward, empty, frame


def base_truth(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_measures(spark):
    texts = awkward()
    got = qr.quality_verdicts(frame(spark, texts)).collect()
    want = sorted((str(i), *base_truth(t)) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.failed_rule is None)
    kept = {r.doc_id for r in got if r.kept}
    assert {5, 6, 7, 9, 14} <= kept and not kept & {1, 2, 3, 4, 10, 11, 13}


def test_codes_beyond_63_bits_are_ranked():
    words = [f"w{i}".encode() for i in range(1_000_001)] + [b"w0", b"w1", b"w2"]
    assert qr.Text(b" ".join(words)).n_repeat_words == 6


def test_order_does_not_change_verdicts():
    texts = [(t or "").encode() for _, t in awkward()]
    rules = (*qr.BASE, *qr.RULES)
    verdicts = [[qr.first_rejecting(list(o), qr.Text(t)) is None for t in texts] for o in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]


def test_order_is_by_rejections_per_cost():
    ticks = iter([0.0, 1.0, 1.0, 3.0, 3.0, 4.0])  # one second for the first rule, two for the second
    a, b = qr.Rule("a", lambda t: t.raw == b"x"), qr.Rule("b", lambda t: t.raw != b"w")
    assert [r.name for r in qr.cascade_order((a, b), [b"w", b"x", b"y", b"z"], clock=lambda: next(ticks))] == ["b", "a"]


def test_order_counts_what_earlier_rules_leave():
    # alone, c rejects more a second than b; after a it rejects nothing more
    ticks = iter([float(k) for k in range(100)])
    a, b, c = qr.Rule("a", lambda t: t.raw in (b"1", b"2", b"3")), qr.Rule("b", lambda t: t.raw == b"4"), qr.Rule("c", lambda t: t.raw in (b"1", b"2"))
    sample = [b"1", b"2", b"3", b"4", b"5"]
    assert [r.name for r in qr.cascade_order((a, b, c), sample, clock=lambda: next(ticks))] == ["a", "b", "c"]
    ticks = iter([float(k) for k in range(100)])
    assert qr.cascade_order((b, c), sample, (a,), lambda: next(ticks))[0] is b


def plain_statistics(t):
    """The twelve statistics from regular expressions."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, _, symbols, dup, repeat = len(w), *base_truth(t)[1:]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, lower, raw = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t)), len(t.encode())

    def odds(part, of):
        s = min(1.0, 2000 / of) if of else 1.0
        return np.log(part * s + 0.5) - np.log(max(of - part, 0) * s + 0.5)

    marks, digits, stops = len(re.findall("!", t)), len(re.findall("[0-9]", t)), len(re.findall("[.,;:?]", t))
    bare = sum(not re.search(r"[A-Za-z]|[^\x00-\x7f]", x) for x in w)
    return [np.log(n + 1), sum(map(len, w)) / n if n else 0, odds(symbols, n + symbols), odds(upper, upper + lower), odds(repeat, n), odds(dup, len(lines)), odds(bare, n), np.log((len(set(w)) + 1) / (n + 1)), odds(marks, n + marks), odds(digits, raw), odds(stops, n + stops), np.log(n / max(len(lines), 1) + 1)]


def test_statistics_equal_brute_force():
    for _, t in awkward():
        assert np.allclose(qc.statistics(t.encode() if t is not None else None), plain_statistics(t), atol=1e-9), t


def test_keep_good_keeps_columns(spark):
    df = frame(spark, awkward())
    got = qr.keep_good(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} >= {5, 6, 14}
    assert qr.keep_good(empty(spark)).count() == 0 and qr.quality_verdicts(empty(spark)).count() == 0


def test_classifier_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels")
    got = {r.doc_id: r for r in qc.score_quality(table(spark, d, "documents"), labels).collect()}
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    s1, s0 = (np.array([s for s, q in held if q == k]) for k in (1, 0))
    assert (s1[:, None] > s0[None, :]).mean() > 0.97 and (s1 >= 0.3).mean() > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for i, r in got.items())


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    d = len(qc.STATISTICS)
    x = {k: rng.normal(k, 1 + k, (400, d)) for k in (0, 1)}
    m = qc.Discriminant({k: (400.0, v.sum(0), v.T @ v) for k, v in x.items()}, pool=0.0, ridge=0.0)
    weight = d / 400

    def log_density(k, p):
        pooled = sum(np.cov(v.T, bias=True) for v in x.values()) / 2
        c = (1 - weight) * np.cov(x[k].T, bias=True) + weight * pooled
        z = p - x[k].mean(0)
        return -0.5 * z @ np.linalg.inv(c) @ z - 0.5 * np.linalg.slogdet(c)[1]

    for p in rng.normal(0.5, 1, (20, d)):
        assert abs(m.score(p[None])[0] - 1 / (1 + np.exp(log_density(0, p) - log_density(1, p)))) < 1e-6


def test_classifier_awkward(spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 1, 0), (14, 1, 1), (10, 0, 0), (11, 0, 0), (13, 0, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality long, toxic long")
    got = qc.score_quality(frame(spark, awkward()), labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert qc.score_quality(empty(spark), labels).count() == 0
    assert {r.score for r in qc.score_quality(frame(spark, awkward()), labels.limit(0)).collect()} == {0.5}
