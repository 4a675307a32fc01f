"""Probability laws, for statistics that the driver holds. Pure Python: none of them runs per row."""

from __future__ import annotations

import math
from statistics import NormalDist

TINY = 1e-300


def _gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, else a continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * front


def chi2_sf(x: float, k: float) -> float:
    return _gamma_upper(k / 2, x / 2)


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by a continued fraction on its fast side."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    guard = lambda v: v if abs(v) > TINY else TINY
    c, d = 1.0, 1 / guard(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 2_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / guard(1 + numerator * d)
            c = guard(1 + numerator / c)
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def _solve(f, low: float, high: float, p: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        if f(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def beta_inv(p: float, a: float, b: float) -> float:
    return _solve(lambda x: beta_cdf(a, b, x), 0.0, 1.0, p)


def chi2_inv(p: float, k: float) -> float:
    high = max(1.0, k)
    while 1 - chi2_sf(high, k) < p:
        high *= 2
    return _solve(lambda x: 1 - chi2_sf(x, k), 0.0, high, p)


def norm_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def norm_cdf(z: float) -> float:
    return norm_sf(-z)


def norm_inv(p: float) -> float:
    """Quantile of the normal law, with one Newton step in the far tails."""
    if p <= 0:
        return -math.inf
    if p >= 1:
        return math.inf
    if p > 1e-15:
        return NormalDist().inv_cdf(p)
    z = -math.sqrt(-2 * math.log(p))
    for _ in range(60):
        step = (math.log(norm_cdf(z)) - math.log(p)) * norm_cdf(z) / (math.exp(-z * z / 2) / math.sqrt(2 * math.pi))
        z -= step
        if abs(step) < 1e-14 * abs(z):
            break
    return z


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_sf2(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hyper_tail(x: int, total: int, marked: int, drawn: int, upper: bool) -> float:
    """P(X >= x) or P(X <= x) of a draw without replacement, summed from x towards the tail."""
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    ways, out = log_choose(total, drawn), 0.0
    mean = drawn * marked / total if total else 0.0
    for k in range(max(x, low), high + 1) if upper else range(min(x, high), low - 1, -1):
        term = math.exp(log_choose(marked, k) + log_choose(total - marked, drawn - k) - ways)
        out += term
        if term < out * 1e-17 and (k > mean if upper else k < mean):
            break
    return min(1.0, out)


def level_test_value(total: int, marked: int, drawn: int, x: int) -> tuple[float, float]:
    """(v, p): the signed normal deviate of x marked among the drawn, and its two-sided probability."""
    if x > drawn * marked / total:
        p = hyper_tail(x, total, marked, drawn, True)
        return -norm_inv(max(p, TINY)), min(1.0, 2 * p)
    p = hyper_tail(x, total, marked, drawn, False)
    return norm_inv(max(p, TINY)), min(1.0, 2 * p)
