"""Scalar statistics on the driver: tails of the t and chi-square distributions, and a shrunk covariance from sums."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # modified Lentz evaluation of 1 / (1 + d1 / (1 + d2 / ...))
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 10.0 * df + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_inc(df / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def pearson_test(n: int, sx: float, sy: float, sxx: float, syy: float, sxy: float) -> tuple[float | None, float | None]:
    """Correlation and its two-sided p-value; None for fewer than 3 points or a constant side."""
    vx, vy = sxx - sx * sx / n if n else 0, syy - sy * sy / n if n else 0
    if n < 3 or vx <= 0 or vy <= 0:
        return None, None
    r = max(-1.0, min(1.0, (sxy - sx * sy / n) / math.sqrt(vx * vy)))
    return r, 0.0 if abs(r) == 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def ledoit_wolf(n: int, sums: np.ndarray, products: np.ndarray, fourth: float) -> np.ndarray:
    """The shrunk covariance of Ledoit and Wolf (2004) from sums over centred rows x: of x, of x x', and of |x|^4."""
    p = len(sums)
    s = products / n - np.outer(sums, sums) / (n * n)
    mu = np.trace(s) / p
    norm = (s * s).sum()
    delta = (norm - p * mu * mu) / p
    beta = min(max((fourth / n - norm) / (n * p), 0.0), delta)
    shrink = beta / delta if delta > 0 else 0.0
    return (1 - shrink) * s + shrink * mu * np.eye(p)
