"""Scores of one item's normalised ranks (lower is better), and ordered-average weights."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * math.erfc((mean - x) / (sd * math.sqrt(2)))


def beta_cdf(x: float, a: int, b: int) -> float:
    """Of whole a and b: the upper tail of a binomial with a + b - 1 trials."""
    if math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    n = a + b - 1
    term = math.exp(math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(n - a + 1) + a * math.log(x) + (n - a) * math.log1p(-x))
    total = term
    for j in range(a + 1, n + 1):
        term *= (n - j + 1) / j * x / (1 - x)
        total += term
    return min(1.0, total)


def beta_inverse(p: float, a: int, b: int) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beta_cdf(middle, a, b) < p else (low, middle)
    return (low + high) / 2


def beta_scores(r: np.ndarray) -> np.ndarray:
    """How likely the i-th smallest of n uniform numbers is to be at most the i-th smallest rank."""
    own = np.sort(r[~np.isnan(r)])
    n = len(own)
    return np.array([beta_cdf(x, i + 1, n - i) for i, x in enumerate(own)])


def stuart(r: np.ndarray) -> float:
    """n! times the probability that sorted uniform numbers lie below the sorted ranks."""
    own = np.sort(r[~np.isnan(r)])
    n = len(own)
    v = [1.0]
    for k in range(1, n + 1):
        x = own[n - k]
        v.append(sum((-1) ** (i - 1) * v[k - i] / math.factorial(i) * x**i for i in range(1, k + 1)))
    return math.factorial(n) * v[n]


def rra(r: np.ndarray, exact: bool = False) -> float:
    scores = beta_scores(r)
    n = len(scores)
    if not n:
        return math.nan
    least = float(scores.min())
    if exact:
        return 1 - stuart(np.array([1 - beta_inverse(least, i + 1, n - i) for i in range(n)]))
    return min(1.0, least * n)


def threshold_rra(r: np.ndarray, cutoff: np.ndarray) -> float:
    """RRA where each list only tells ranks above its cut-off; a rank of 1 counts as missing."""
    own = np.where(r >= 1.0, np.nan, np.asarray(r, float))
    if len(cutoff) != len(own):
        raise ValueError("one cut-off for each list")
    n, cut = len(own), np.sort(cutoff)[::-1]
    seen = np.sort(own[~np.isnan(own)])
    if not len(seen):
        return 1.0
    # probability that at least k + 1 of the lists show a rank of x or less, each at most up to its cut-off
    scores = []
    for k, x in enumerate(seen):
        dist = np.zeros(n + 1)
        dist[0] = 1.0
        for c in cut:
            p = min(x, c)
            dist[1:] = dist[1:] * (1 - p) + dist[:-1] * p
            dist[0] *= 1 - p
        scores.append(dist[k + 1 :].sum())
    return float(min(1.0, min(scores) * n))


def upper_median(r: np.ndarray) -> float:
    own = np.sort(r)
    return float(own[len(own) // 2])


def _moments(mu: float, sd: float) -> tuple[float, float]:
    """Mean and standard deviation of a normal distribution cut to 0 .. 1."""
    a, b = (0 - mu) / sd, (1 - mu) / sd
    z = normal_cdf(b) - normal_cdf(a)
    if z <= 0:
        return math.nan, math.nan
    pa, pb = (math.exp(-x * x / 2) / math.sqrt(2 * math.pi) for x in (a, b))
    mean = mu + sd * (pa - pb) / z
    var = sd * sd * (1 + (a * pa - b * pb) / z - ((pa - pb) / z) ** 2)
    return mean, math.sqrt(max(var, 0.0))


def _nelder_mead(f, start: np.ndarray, step: np.ndarray, budget: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    points = [start, *(start + np.eye(len(start))[i] * step[i] for i in range(len(start)))]
    values, used = [f(p) for p in points], len(start) + 1
    while used < budget:
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            return points[0]
        centre, worst = np.mean(points[:-1], axis=0), points[-1]
        move = lambda t: (p := centre + t * (worst - centre), f(p))  # noqa: B023, E731
        p, v = move(-1.0)
        used += 1
        if v < values[0]:
            q, u = move(-2.0)
            used += 1
            p, v = (q, u) if u < v else (p, v)
        elif v >= values[-2]:
            q, u = move(-0.5 if v < values[-1] else 0.5)
            used += 1
            if u < min(v, values[-1]):
                p, v = q, u
            else:
                points = [points[0], *(points[0] + 0.5 * (x - points[0]) for x in points[1:])]
                values = [values[0], *(f(x) for x in points[1:])]
                used += len(points) - 1
                continue
        points[-1], values[-1] = p, v
    return points[int(np.argmin(values))]


@lru_cache(256)
def owa_shape(risk: float) -> tuple[float, float] | None:
    """Centre and spread of the normal density whose part in 0 .. 1 has the mean ``risk`` and the deviation that its trade-off asks for; None at 0 and 1, where one rank has all weight."""
    if not 0 <= risk <= 1:
        raise ValueError("risk is 0 to 1")
    trade = 4 * risk * (1 - risk)
    if trade == 0:
        return None
    sd = trade / (2 * math.sqrt(3))

    def miss(p: np.ndarray) -> float:
        if p[1] <= 0:
            return math.inf
        m, s = _moments(float(p[0]), float(p[1]))
        return math.inf if math.isnan(m) or math.isnan(s) else (m - risk) ** 2 + (s - sd) ** 2

    mu, spread = _nelder_mead(miss, np.array([risk, sd]), np.array([risk, sd]))
    return float(mu), float(spread)


@lru_cache(256)
def owa_weights(n: int, risk: float) -> tuple[float, ...]:
    """Weights of ranks sorted from worst to best. Risk near 1 looks at the best rank, near 0 at the worst, 0.5 at their mean."""
    if n < 1 or not 0 <= risk <= 1:
        raise ValueError("n is at least 1, risk is 0 to 1")
    if n == 1:
        return (1.0,)
    at, shape = np.arange(n) / (n - 1), owa_shape(risk)
    if shape is None:
        return tuple(float(i == int(np.argmin(np.abs(at - risk)))) for i in range(n))
    logs = -(((at - shape[0]) / shape[1]) ** 2) / 2
    w = np.exp(logs - logs.max())
    if not np.isfinite(w).all() or w.sum() <= 0:
        raise ValueError(f"no weights for n = {n}, risk = {risk}")
    return tuple((w / w.sum()).tolist())


def orness(w: np.ndarray) -> float:
    n = len(w)
    return float(sum(i * x for i, x in enumerate(w)) / (n - 1)) if n > 1 else 0.5


def andness(w: np.ndarray) -> float:
    return 1 - orness(w)


def dispersion(w: np.ndarray) -> float:
    """1 for equal weights, 0 for one alone."""
    return float(-sum(x * math.log(x) for x in w if x > 0) / math.log(len(w))) if len(w) > 1 else 0.0


def trade_off(w: np.ndarray) -> float:
    n = len(w)
    return float(1 - math.sqrt(n * sum((x - 1 / n) ** 2 for x in w) / (n - 1))) if n > 1 else 1.0


def owa(r: np.ndarray, weights: tuple[float, ...]) -> float:
    return float(np.dot(np.sort(r)[::-1], weights))
