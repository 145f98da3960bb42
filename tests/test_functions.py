import math

import numpy as np
import pytest
from rankforge.functions import fusing, solvers

# Three ranked lists, and below the scores and orders that they give.
LISTS = [
    ["x", "o", "m", "w"],
    ["d", "x", "h", "i", "r", "t", "a", "g", "v", "k"],
    ["e", "y", "t", "q", "m", "c", "x", "u", "z", "i", "v", "h"],
]
ITEMS = sorted(set(sum(LISTS, [])))


def matrix(n):
    return {i: np.array([(r.index(i) + 1) / n if i in r else 1.0 for r in LISTS]) for i in ITEMS}


# The five least scores.
@pytest.mark.parametrize(
    ("score", "n", "want"),
    [
        (fusing.stuart, 26, [0.00295858, 0.08192990, 0.10292444, 0.11100364, 0.11100364]),
        (fusing.stuart, 19, [0.00758128, 0.14564805, 0.14973028, 0.14973028, 0.18107596]),
        (fusing.rra, 26, [0.05052344, 0.29016841, 0.33301092, 0.33301092, 0.40555303]),
        (fusing.rra, 19, [0.09272489, 0.44919084, 0.44919084, 0.51392331, 0.70855810]),
        (fusing.upper_median, 19, [0.1052632, 0.2631579, 0.3157895, 0.5263158, 0.5789474]),
        (lambda r: fusing.normal_cdf(r.mean(), 0.5, (1 / 12 / 3) ** 0.5), 19, [0.02574529, 0.43726987, 0.47901273, 0.68213744, 0.71868766]),
    ],
)
def test_scores(score, n, want):
    assert np.allclose(sorted(score(r) for r in matrix(n).values())[:5], want, atol=1e-7)


# Orders by risk.
@pytest.mark.parametrize(("risk", "want"), [(0.95, "xdeoy"), (0.5, "xmtihvdeoyqwrcaguzk"), (0.05, "xmtivhdeoyqwrcaguzk")])
def test_owa_orders(risk, want):
    w = fusing.owa_weights(3, risk)
    assert sum(w) == pytest.approx(1)
    order = sorted(ITEMS, key=lambda i: (round(fusing.owa(matrix(19)[i], w), 12), i))
    assert "".join(order).startswith(want)


def test_owa_weights():
    assert fusing.owa_weights(3, 0.25) == pytest.approx((0.833222, 0.146304, 0.0204738), abs=1e-5)
    assert fusing.owa_weights(4, 1.0) == (0, 0, 0, 1)
    assert fusing.owa_weights(1, 0.3) == (1.0,)
    assert fusing.orness(np.array([0.25] * 4)) == pytest.approx(0.5)
    assert fusing.dispersion(np.array([0.25] * 4)) == pytest.approx(1)
    assert fusing.trade_off(np.array([0, 0, 0, 1.0])) == pytest.approx(0)
    with pytest.raises(ValueError):
        fusing.owa_weights(3, 1.5)


def test_exact_and_threshold_rra():
    r = np.array([0.1, 0.4, 0.7])
    assert 0 < fusing.rra(r, exact=True) <= fusing.rra(r) + 1e-12
    assert fusing.threshold_rra(r, np.ones(3)) == pytest.approx(fusing.rra(r))
    assert fusing.threshold_rra(np.ones(3), np.ones(3)) == 1.0
    with pytest.raises(ValueError):
        fusing.threshold_rra(r, np.ones(2))
    assert fusing.beta_cdf(fusing.beta_inverse(0.3, 2, 3), 2, 3) == pytest.approx(0.3)
    assert math.isnan(fusing.beta_cdf(math.nan, 1, 1))


def test_positive_definite():
    good, bad = np.array([[1, 0.3, 0.9], [0.3, 1, 0.5], [0.9, 0.5, 1]]), np.array([[1, 0.1, 0.8], [0.1, 1, 0.9], [0.8, 0.9, 1]])
    assert solvers.is_positive_definite(good) and not solvers.is_positive_definite(bad)
    assert solvers.is_positive_definite(solvers.nearest_positive_definite(bad))


def test_quadratic_is_optimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20):
        a = rng.normal(size=(n, 2 * n))
        q, c = a @ a.T / n, rng.random(n)
        w = solvers.quadratic(q, c, 0.4)
        assert w.sum() == pytest.approx(1) and (w >= 0).all()
        slope = 0.6 * q @ w - 0.4 * c
        assert slope[w > 1e-9].max() - slope.min() < 1e-6
    assert len(solvers.quadratic(np.empty((0, 0)), np.empty(0))) == 0
    with pytest.raises(ValueError):
        solvers.quadratic(np.eye(2), np.ones(2), 1.5)


def test_truncated_power_keeps_the_largest():
    m = np.diag([3.0, 2.0, 1.0]) + 0.1
    x = solvers.truncated_power(m, 1)
    assert np.flatnonzero(x).tolist() == [0]
    assert np.allclose(np.abs(solvers.truncated_power(m)), np.abs(np.linalg.eigh(m)[1][:, -1]), atol=1e-3)
