"""Distribution functions in NumPy: normal, t, chi-square, F.  Spark SQL has none of them."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, pi, sqrt

import numpy as np

_erfc = np.vectorize(erfc, otypes=[float])


def norm_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / sqrt(2))


def norm_sf(x):
    return norm_cdf(-np.asarray(x, float))


def norm_pdf(x):
    return np.exp(-0.5 * np.asarray(x, float) ** 2) / sqrt(2 * pi)


def norm_ppf(p: float) -> float:
    """By bisection and Newton steps on the exact distribution function."""
    if not 0 < p < 1:
        return float("nan") if not 0 <= p <= 1 else (-np.inf if p == 0 else np.inf)
    lo, hi = -40.0, 40.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * erfc(-mid / sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b or tiny
        c = b + an / c or tiny
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2) if x > 0 else 1.0


def t_sf(x: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + x * x))
    return tail if x >= 0 else 1 - tail


def t_two_sided(x: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + x * x))


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0
