"""Small dense solvers."""

from __future__ import annotations

import numpy as np


def is_symmetric(m: np.ndarray) -> bool:
    return m.ndim == 2 and m.shape[0] == m.shape[1] and bool((m == m.T).all())


def is_positive_definite(m: np.ndarray) -> bool:
    """Symmetric with a Cholesky factor; NaN is not."""
    if not is_symmetric(m) or not np.isfinite(m).all():
        return False
    try:
        np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        return False
    return True


def symmetrise(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def nearest_positive_definite(m: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mean of the symmetric part and its polar factor, raised along the diagonal until a Cholesky factor exists."""
    b = symmetrise(np.asarray(m, float))
    _, s, v = np.linalg.svd(b)
    out = symmetrise((b + v.T @ np.diag(s) @ v) / 2)
    eye, least = np.eye(len(out)), np.finfo(float).eps * max(1.0, np.abs(out).max())
    for k in range(rounds):
        if is_positive_definite(out):
            return out
        out = symmetrise(out + eye * (max(0.0, -np.linalg.eigvalsh(out)[0]) + least * 2.0**k))
    raise ValueError("no positive definite matrix was reached")


def balance_factor(q: np.ndarray, c: np.ndarray) -> float:
    """Share of relevance against redundancy: mean(q) / (mean(q) + mean(c))."""
    return float(q.mean() / (q.mean() + c.mean()))


def quadratic(q: np.ndarray, c: np.ndarray, alpha: float | None = None, correct: bool = False, rounds: int = 10_000) -> np.ndarray:
    """w >= 0 of sum 1 that minimises (1 - alpha) w'qw / 2 - alpha c'w, by active sets.

    Features with negative weight leave one step at a time; at a minimum over the rest, the one whose multiplier is most
    violated comes back. A matrix that is not positive definite gets a ridge, or its nearest definite one with ``correct``.
    """
    n = len(c)
    if n == 0:
        return np.empty(0)
    if n == 1:
        return np.ones(1)
    alpha = balance_factor(q, c) if alpha is None else alpha
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be 0 to 1")
    h = (1 - alpha) * symmetrise(q)
    if correct:
        h = nearest_positive_definite(h)
    least = np.linalg.eigvalsh(h)[0]
    if least <= 1e-10:
        h = h + np.eye(n) * (1e-8 - min(least, 0.0))
    g, w, on = alpha * c, np.full(n, 1 / n), np.ones(n, bool)
    for _ in range(rounds):
        i = np.flatnonzero(on)
        a = np.zeros((len(i) + 1, len(i) + 1))
        a[:-1, :-1], a[:-1, -1], a[-1, :-1] = h[np.ix_(i, i)], 1, 1
        x = np.linalg.solve(a, np.append(g[i], 1.0))
        goal, level = x[:-1], x[-1]
        if (goal < -1e-12).any():
            step = goal - w[i]
            back = step < 0
            ratio = np.where(back, w[i] / np.where(back, -step, 1.0), np.inf)
            t = min(1.0, ratio.min())
            w[i] = np.maximum(w[i] + t * step, 0.0)
            gone = i[int(ratio.argmin())]
            w[gone], on[gone] = 0.0, False
            continue
        w[:] = 0.0
        w[i] = np.maximum(goal, 0.0)
        slope = h @ w - g + level
        slope[on] = 0.0
        k = int(slope.argmin())
        if slope[k] >= -1e-10:
            return w / w.sum()
        on[k] = True
    return w / w.sum()


def spectral(m: np.ndarray) -> np.ndarray:
    """Absolute unit eigenvector of the largest eigenvalue, of the matrix brought to 0 .. 1."""
    m = symmetrise(np.asarray(m, float))
    low, high = m.min(), m.max()
    own = (m - low) / (high - low) if high > low else np.zeros_like(m)
    return np.abs(np.linalg.eigh(own)[1][:, -1])


def truncate(v: np.ndarray, keep: int) -> np.ndarray:
    """Unit vector of the ``keep`` largest entries by size, the others 0."""
    out = np.zeros_like(v)
    at = np.argsort(-np.abs(v), kind="stable")[:keep]
    out[at] = v[at]
    length = np.linalg.norm(out)
    return out / length if length else out


def truncated_power(m: np.ndarray, keep: int | None = None, rounds: int = 49, tolerance: float = 1e-6) -> np.ndarray:
    """Sparse leading eigenvector by power steps, each cut to ``keep`` entries (default: all)."""
    m = symmetrise(np.asarray(m, float))
    keep = len(m) if keep is None else keep
    x = np.zeros(len(m))
    x[np.argsort(-np.diag(m), kind="stable")[:keep]] = 1.0
    x /= np.linalg.norm(x)
    value = x @ (m @ x)
    for _ in range(rounds):
        x = truncate(m @ x, keep)
        now = x @ (m @ x)
        if abs(now - value) < tolerance:
            break
        value = now
    return x
