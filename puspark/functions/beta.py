"""Beta distribution on NumPy arrays: maximum likelihood from sufficient statistics, and tail probability."""

from __future__ import annotations

import numpy as np

SHIFT = 10  # arguments are lifted by this much before the asymptotic series are used


def _digamma(z):
    z = np.asarray(z, dtype=np.float64)
    y = z + SHIFT
    q = 1.0 / (y * y)
    series = np.log(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132))))
    return series - sum(1.0 / (z + j) for j in range(SHIFT))


def _trigamma(z):
    z = np.asarray(z, dtype=np.float64)
    y = z + SHIFT
    q = 1.0 / (y * y)
    series = 1 / y + q / 2 + q / y * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q * (1 / 30 - q * 5 / 66))))
    return series + sum(1.0 / (z + j) ** 2 for j in range(SHIFT))


def _stirling_remainder(z):
    """ln Gamma(z) less its leading Stirling terms."""
    y = np.where(z < SHIFT, z + SHIFT, z)
    q = 1.0 / (y * y)
    tail = (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q / 1680))) / y
    lifted = (y - 0.5) * np.log(y) - y + tail - sum(np.log(z + j) for j in range(SHIFT))
    return np.where(z < SHIFT, lifted - ((z - 0.5) * np.log(z) - z), tail)


def fit(mean, var, mean_log, mean_log1m, rounds=60):
    """Maximum-likelihood shapes by Newton steps from the moment estimates, every unfinished entity at once."""
    spread = mean * (1 - mean) / var - 1
    shape1, shape2 = mean * spread, (1 - mean) * spread
    todo = np.flatnonzero(np.isfinite(shape1) & np.isfinite(shape2))
    for _ in range(rounds):
        if not len(todo):
            break
        a, b = shape1[todo], shape2[todo]
        both = _digamma(a + b)
        ga = mean_log[todo] - _digamma(a) + both
        gb = mean_log1m[todo] - _digamma(b) + both
        ta, tb, tc = _trigamma(a), _trigamma(b), _trigamma(a + b)
        det = ta * tb - tc * (ta + tb)
        da = ((tb - tc) * ga + tc * gb) / det
        db = (tc * ga + (ta - tc) * gb) / det
        usable = np.isfinite(da) & np.isfinite(db)
        da, db = np.where(usable, da, 0.0), np.where(usable, db, 0.0)
        shape1[todo], shape2[todo] = np.maximum(a + da, a / 3), np.maximum(b + db, b / 3)
        # convergence is quadratic: after a step this small the next one is below rounding
        todo = todo[(np.abs(da) > 1e-9 * a) | (np.abs(db) > 1e-9 * b)]
    return shape1, shape2


def _fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz), every unfinished entity at once."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    out = np.empty_like(x)
    todo = np.arange(len(x))
    c = np.ones_like(x)
    d = 1 / away(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, int(200 + 8 * np.sqrt(np.max(a + b, initial=1.0)))):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / away(1 + top * d)
            c = away(1 + top / c)
            value = value * (c * d)
        going = np.abs(c * d - 1) > 1e-14
        if not going.all():
            out[todo[~going]] = value[~going]
            todo, a, b, x, c, d, value = (v[going] for v in (todo, a, b, x, c, d, value))
        if not len(todo):
            return out
    out[todo] = value
    return out


def upper_tail(a, b, x, upper):
    """P(Beta(a, b) > x) where ``upper`` is true, P(Beta(a, b) <= x) elsewhere; ``x`` is one number."""
    if x <= 0 or x >= 1:
        below = np.full(a.shape, 0.0 if x <= 0 else 1.0)
        return np.where(upper, 1 - below, below)
    both = a + b
    mean = a / both
    front = np.exp(
        a * np.log(x / mean)
        + b * np.log((1 - x) / (1 - mean))
        + 0.5 * np.log(a / (2 * np.pi) * (b / both))
        + _stirling_remainder(both) - _stirling_remainder(a) - _stirling_remainder(b)
    )
    left = x < (a + 1) / (both + 2)
    p, q = np.where(left, a, b), np.where(left, b, a)
    near = front * _fraction(p, q, np.where(left, x, 1 - x)) / p
    return np.clip(np.where(left == upper, 1 - near, near), 0.0, 1.0)
