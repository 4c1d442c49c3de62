import math

import numpy as np

from zonewright.functions import kernels as k


def mulberry(seed):
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
        t = ((t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def test_counter_draws_equal_the_sequence():
    g = mulberry(424242)
    want = [next(g) for _ in range(3000)]
    assert np.allclose(k.counter_uniform(424242, 0, 3000), want, atol=0) and np.allclose(k.counter_uniform(424242, 1000, 500), want[1000:1500], atol=0)


def plain_jaro_winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    w = max(0, max(len(a), len(b)) // 2 - 1)
    ma, mb = [False] * len(a), [False] * len(b)
    for i, x in enumerate(a):
        for j in range(max(0, i - w), min(len(b), i + w + 1)):
            if not mb[j] and b[j] == x:
                ma[i] = mb[j] = True
                break
    x, y = [c for c, m in zip(a, ma) if m], [c for c, m in zip(b, mb) if m]
    if not x:
        return 0.0
    t = sum(p != q for p, q in zip(x, y)) / 2
    j = (len(x) / len(a) + len(x) / len(b) + (len(x) - t) / len(x)) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + p * 0.1 * (1 - j)


def test_jaro_winkler():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        a, b = ("".join(rng.choice(list("abcd "), rng.integers(0, 12))) for _ in range(2))
        assert math.isclose(k.jaro_winkler(a, b), plain_jaro_winkler(a, b), abs_tol=1e-12), (a, b)
    assert k.jaro_winkler("martha", "marhta") > 0.85 and k.jaro_winkler("wanjiku", "otieno") < 0.6


def test_nb_quantile_sums_exactly_and_does_not_underflow():
    for m, size, q in ((3.0, 2.0, 0.975), (40.0, 5.0, 0.025), (0.4, 1.0, 0.5)):
        p, y, total = (size / (size + m)) ** size, 0, 0.0
        while True:
            total += p
            if total >= q:
                break
            y += 1
            p *= (y + size - 1) / y * m / (size + m)
        assert k.nb_quantile(m, size, q) == y
    assert k.nb_quantile(1900, 1900, 0.025) < 1900 < k.nb_quantile(1900, 1900, 0.975) < 2200
    assert k.nb_quantile(0, 1, 0.9) == 0


def test_poisson_gamma():
    rng = np.random.default_rng(1)
    y = rng.poisson(np.exp(1 + 0.03 * np.arange(40)))
    level, slope, cov, dispersion = k.loglinear_fit(y.astype(float))
    assert abs(slope - 0.03) < 0.02 and dispersion >= 1 and cov[0, 0] > 0
    f = k.poisson_gamma(y, 3)
    assert f.shape == (3, 3) and (f[:, 1] <= f[:, 0]).all() and (f[:, 0] <= f[:, 2]).all()
    assert k.poisson_gamma([], 2).tolist() == [[0, 0, 0]] * 2 and k.poisson_gamma([1, 2], 1)[0][0] == 3.5 / 2.5


def plain_holt_winters(y, a, b, g, p):
    n, c = len(y), len(y) // p
    level = sum(y[:p]) / p
    trend = (sum(y[p : 2 * p]) - sum(y[:p])) / p / p
    s = [np.mean([y[q * p + i] - np.mean(y[q * p : q * p + p]) for q in range(c)]) for i in range(p)]
    s = [x - np.mean(s) for x in s]
    out = []
    for t in range(n):
        out.append(level + trend + s[t % p])
        if t >= p:
            new = a * (y[t] - s[t % p]) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            s[t % p] = g * (y[t] - new) + (1 - g) * s[t % p]
            level = new
    return out


def test_holt_winters():
    rng = np.random.default_rng(2)
    y = 50 + np.arange(48) + 10 * np.sin(np.arange(48) * math.pi / 6) + rng.normal(0, 2, 48)
    r = k.holt_winters(y, 3)
    assert r["mae"] < 0.3 * y.mean() and r["searched"] and (r["lower95"] <= r["mean"]).all()
    fixed = k.holt_winters(y, 3, alpha=0.3, beta=0.1, gamma=0.2)
    assert not fixed["searched"] and np.allclose(fixed["fitted"], plain_holt_winters(list(y), 0.3, 0.1, 0.2, 12))
    grid = [(np.abs(y - np.array(plain_holt_winters(list(y), a, b, g, 12)))[12:].mean()) for a in k.ALPHAS for b in k.BETAS for g in k.GAMMAS]
    assert abs(min(grid) - r["mae"]) < 1e-9
    short = k.holt_winters(y[:10], 2)
    assert short["period"] == 1 and short["mae"] == 0


def test_logistic_auc_percentile():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0).astype(float)
    score = k.predict_logistic(k.fit_logistic(x, y), x)
    pairs = [(p > q) + 0.5 * (p == q) for p in score[y == 1] for q in score[y == 0]]
    assert abs(k.rank_auc(score, y) - np.mean(pairs)) < 1e-12 and np.mean(pairs) > 0.9
    assert k.rank_auc(score, np.ones(300)) == 0.5 and k.percentile(np.array([1.0, 2, 3, 4]), 0.75) == 3.25


def test_capture_and_simplify():
    assert k.chapman(10, 8, 0) is None and k.chapman(10, 8, 4) == 99 / 5 - 1
    assert 100 < k.three_list_total(100, (60, 50, 40)) <= 800
    line = np.array([[0, 0], [1, 0.01], [2, -0.01], [3, 5], [4, 6], [5, 7], [6, 7.0]])
    assert k.simplify(line, 0.5).tolist() == [True, False, True, True, False, True, True]
