"""Numeric kernels that no column expression states: they work on arrays and run inside Arrow functions."""

from __future__ import annotations

import math

import numpy as np

# ---- random numbers ----

_STEP = 0x6D2B79F5
_MASK = np.uint64(0xFFFFFFFF)


def counter_uniform(seed: int, first: int, n: int) -> np.ndarray:
    """Draws first, first + 1, ... of the 32-bit generator mulberry32: its state is seed + step * (draw + 1), so any draw is reached at once."""
    a = (np.uint64(seed & 0xFFFFFFFF) + np.uint64(_STEP) * np.arange(first + 1, first + n + 1, dtype=np.uint64)) & _MASK
    t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & _MASK
    t = ((t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & _MASK)) & _MASK) ^ t
    return (t ^ (t >> np.uint64(14))).astype(np.float64) / 4294967296.0


def replication(seed: int, number: int) -> np.random.Generator:
    """The generator of one replication: counter-based, with 128 bits of counter per key, so streams of different numbers never meet."""
    return np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFFFFFFFFFF, number]))


# ---- strings ----


def jaro_winkler(a: str, b: str, weight: float = 0.1, longest: int = 4) -> float:
    """Similarity of two normalised strings: Jaro with halves of transpositions kept, raised by the common prefix at any level."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left, taken = [], []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), min(len(b), i + reach + 1))
        while j >= 0 and not free[j]:
            j = b.find(ch, j + 1, min(len(b), i + reach + 1))
        if j >= 0:
            free[j] = False
            left.append(ch)
            taken.append(j)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(left, sorted(taken), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k in range(min(longest, len(a), len(b))) if a[k] != b[k]), min(longest, len(a), len(b)))
    return jaro + prefix * weight * (1 - jaro)


# ---- capture-recapture ----


def chapman(n_a: float, n_b: float, both: float) -> float | None:
    return None if both == 0 else (n_a + 1) * (n_b + 1) / (both + 1) - 1


def three_list_total(seen: int, lists: tuple[int, int, int]) -> float:
    """Independence estimate of the total from three lists by fixed point, at most 100 steps, stopped below 0.01, capped at eight times what was seen."""
    if not seen:
        return 0.0

    def step(total: float) -> float | None:
        missed = math.prod(1 - n / total for n in lists)
        return None if missed >= 1 - 1e-12 else seen / (1 - missed)

    total = step(seen)
    if total is None:
        return float(seen * 8)
    for _ in range(100):
        following = step(total)
        if following is None:
            return total
        done, total = abs(following - total) < 0.01, following
        if done:
            break
    return min(total, seen * 8.0)


# ---- forecasts ----


def nb_quantile(mean: float, size: float, q: float) -> int:
    """Quantile of a negative binomial by summing its probabilities in log space, so that large means do not underflow."""
    if mean <= 1e-9:
        return 0
    k = min(max(size, 1e-9), 1e12)
    cap = math.ceil(mean + 15 * math.sqrt(mean + 1) + 200)
    y = np.arange(1, cap + 1, dtype=np.float64)
    log_p0 = -k * math.log1p(mean / k)
    steps = np.log((y + k - 1) / y) + math.log(mean / (k + mean))
    p = np.exp(log_p0 + np.concatenate([[0.0], np.cumsum(steps)]))
    total = np.cumsum(p)
    over = np.flatnonzero((total >= q) | ((p < 1e-16) & (total > 0.5)))
    return int(over[0]) if len(over) else cap


def loglinear_fit(y: np.ndarray) -> tuple[float, float, np.ndarray, float]:
    """Level, slope (within 0.3), their covariance and the dispersion (1 to 25) of a Poisson trend.

    Newton steps on the likelihood with a N(0, 100) prior on the slope, halved up to ten times until they do not lose.
    """
    prior = 0.01
    t = np.arange(len(y)) - (len(y) - 1) / 2

    def loss(c: np.ndarray) -> float:
        eta = c[0] + c[1] * t
        return float((np.exp(eta) - y * eta).sum() + prior * c[1] ** 2 / 2)

    def information(rate: np.ndarray) -> np.ndarray:
        return np.array([[rate.sum(), (rate * t).sum()], [(rate * t).sum(), (rate * t * t).sum() + prior]])

    c = np.array([math.log(y.mean() + 0.25), 0.0])
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(80):
            rate = np.exp(c[0] + c[1] * t)
            h, g = information(rate), np.array([(y - rate).sum(), ((y - rate) * t).sum() - prior * c[1]])
            det = h[0, 0] * h[1, 1] - h[0, 1] ** 2
            if not math.isfinite(det) or det <= 1e-12:
                break
            move = np.array([g[0] * h[1, 1] - g[1] * h[0, 1], g[1] * h[0, 0] - g[0] * h[0, 1]]) / det
            if np.abs(move).max() < 1e-11:
                break
            now = loss(c)
            better = next((s for s in 0.5 ** np.arange(10) if loss(c + s * move) < now + 1e-12), None)
            if better is None:
                break
            c = c + better * move
        c[1] = min(0.3, max(-0.3, c[1]))
        rate = np.exp(c[0] + c[1] * t)
    used = rate > 1e-12
    dispersion = max(1.0, min(float(((y - rate)[used] ** 2 / rate[used]).sum()) / max(1, len(y) - 2), 25.0))
    h = information(rate)
    det = h[0, 0] * h[1, 1] - h[0, 1] ** 2
    cov = np.array([[h[1, 1], -h[0, 1]], [-h[0, 1], h[0, 0]]]) / det if det > 1e-12 else np.eye(2)
    return float(c[0]), float(c[1]), cov * dispersion, dispersion


def poisson_gamma(series: np.ndarray, horizon: int) -> np.ndarray:
    """Rows of (mean, low, high) for the next months: a damped trend (0.95), with 95 % bounds of a negative binomial. Under four months: a Gamma(0.5, 0.5) prior."""
    y, n, horizon = np.asarray(series, dtype=float), len(series), max(1, round(horizon))
    if not n:
        return np.zeros((horizon, 3))

    def row(mean: float, size: float) -> list[float]:
        low, high = nb_quantile(mean, size, 0.025), nb_quantile(mean, size, 0.975)
        return [mean, low, max(high, math.ceil(mean), low)]

    if n < 4:
        return np.array([row((y.sum() + 0.5) / (n + 0.5), y.sum() + 0.5)] * horizon)
    level, slope, cov, dispersion = loglinear_fit(y)
    at = (n - 1) / 2 + np.cumsum(0.95 ** np.arange(1, horizon + 1))
    out = []
    for s in at:
        v = max(0.0, cov[0, 0] + 2 * cov[0, 1] * s + cov[1, 1] * s * s)
        mean = math.exp(min(20.0, max(-20.0, level + slope * s)) + v / 2)
        spread = max(dispersion - 1, 0) + mean * math.expm1(v)
        out.append(row(mean, max(mean / spread, 1e-9) if spread > 0 else 1e12))
    return np.array(out)


#: The grid of smoothing parameters.
ALPHAS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75)
BETAS = GAMMAS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3)


def holt_winters(series: np.ndarray, horizon: int, period: int = 12, alpha: float | None = None, beta: float | None = None, gamma: float | None = None) -> dict:
    """Additive Holt-Winters; parameters not given are searched on a fixed grid for the least mean absolute one-step error after the first cycle.

    All combinations run side by side, one array lane each. The first lane that is better by more than 1e-12 wins.
    """
    y, n, horizon = np.asarray(series, dtype=float), len(series), max(1, round(horizon))
    period = max(1, round(period))
    seasonal = period >= 2 and n >= 2 * period
    given = lambda v, low: v if v is not None and low <= v <= 0.99 else None
    a, b = given(alpha, 0.01), given(beta, 0.0)
    g = given(gamma, 0.0) if seasonal else 0.0
    searched = a is None or b is None or g is None
    lanes = np.array([(x, z, w) for x in (ALPHAS if a is None else (a,)) for z in (BETAS if b is None else (b,)) for w in (GAMMAS if g is None else (g,))])
    fitted, state = _smooth(y, lanes, period, seasonal)
    errors = np.abs(y[period:, None] - fitted[period:]) if n > period else np.zeros((0, len(lanes)))
    best, mae = (0, errors.mean(axis=0)[0]) if len(errors) else (None, 0.0)
    if len(errors):
        for k, v in enumerate(errors.mean(axis=0)):
            if v < mae - 1e-12:
                best, mae = k, v
    if best is None:  # nothing to compare: defaults where none is given
        lanes = np.array([(a if a is not None else 0.3, b if b is not None else 0.1, (g if g is not None else 0.1))])
        fitted, state = _smooth(y, lanes, period, seasonal)
        best = 0
    level, trend, season = state[0][best], state[1][best], state[2][:, best]
    residual = (y - fitted[:, best])[period:]
    sd = math.sqrt((residual**2).mean()) if len(residual) > 1 else 0.0
    h = np.arange(1, horizon + 1)
    mean = np.maximum(0, level + h * trend + (season[(n - 1 + h) % period] if seasonal else 0))
    width = 1.96 * sd * np.sqrt(h)
    return {"mean": mean, "lower95": np.maximum(0, mean - width), "upper95": mean + width, "fitted": fitted[:, best], "residual_sd": sd, "mae": float(mae), "alpha": float(lanes[best, 0]), "beta": float(lanes[best, 1]), "gamma": float(lanes[best, 2]) if seasonal else 0.0, "period": period if seasonal else 1, "searched": searched}


def _smooth(y: np.ndarray, lanes: np.ndarray, period: int, seasonal: bool) -> tuple[np.ndarray, tuple]:
    n, k = len(y), len(lanes)
    a, b, g = lanes.T
    season = np.zeros((period, k))
    if seasonal:
        cycles = y[: n // period * period].reshape(-1, period)
        season += (cycles - cycles.mean(axis=1, keepdims=True)).mean(axis=0)[:, None]
        season -= season.mean(axis=0)
        level = np.full(k, cycles[0].mean())
        trend = np.full(k, (cycles[1].mean() - cycles[0].mean()) / period)
    else:
        level = np.full(k, y.mean() if n else 0.0)
        trend = np.full(k, (y[-1] - y[0]) / (n - 1) if n >= 2 else 0.0)
        g = np.zeros(k)
    fitted = np.zeros((n, k))
    for t in range(n):
        s = season[t % period]
        fitted[t] = level + trend + s
        if t < period:
            continue
        new = a * (y[t] - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        if seasonal:
            season[t % period] = g * (y[t] - new) + (1 - g) * s
        level = new
    return fitted, (level, trend, season)


# ---- classifier ----


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def fit_logistic(x: np.ndarray, y: np.ndarray, rate: float = 0.1, ridge: float = 0.01, epochs: int = 500) -> dict:
    """Gradient descent from zero on standardised columns (population deviation, at least 1e-6); the bias is not penalised."""
    mean, sd = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    w, bias = np.zeros(x.shape[1]), 0.0
    if len(x):
        z = (x - mean) / sd
        for _ in range(epochs):
            error = sigmoid(z @ w + bias) - y
            w, bias = w - rate * (z.T @ error / len(x) + ridge * w), bias - rate * error.mean()
    return {"weights": w, "bias": bias, "mean": mean, "sd": sd}


def predict_logistic(model: dict, x: np.ndarray) -> np.ndarray:
    return sigmoid((x - model["mean"]) / model["sd"] @ model["weights"] + model["bias"])


def percentile(x: np.ndarray, q: float) -> float:
    """Linear between the neighbours; 0 for nothing."""
    return float(np.quantile(x, q)) if len(x) else 0.0


def rank_auc(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the curve from ranks, equals sharing their mean rank; 0.5 with one class only."""
    positive = label == 1
    n1, n0 = int(positive.sum()), int((~positive).sum())
    if not n1 or not n0:
        return 0.5
    _, where, times = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[where]
    return float((rank[positive].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


# ---- geometry ----


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: which points of a line stay so that none is further than tolerance from it (a mask)."""
    keep = np.zeros(len(points), dtype=bool)
    if not len(points):
        return keep
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d, p = points[i], points[j] - points[i], points[i + 1 : j] - points[i]
        length = math.hypot(*d)
        far = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / length if length else np.hypot(*(points[i + 1 : j] - a).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep
