"""Tail probabilities and response surfaces for statistics on result rows (a handful of numbers, never row data)."""

from __future__ import annotations

import math

import numpy as np

from ..fixed_values import KPSS_P, KPSS_POINTS

# MacKinnon (1994) response surfaces for one series, by trend term: switch point, lower and upper bounds,
# coefficients below and above the switch point.
MACKINNON = {
    "n": (-1.04, -19.04, math.inf, [0.6344, 1.2378, 0.032496], [0.4797, 0.93557, -0.06999, 0.033066]),
    "c": (-1.61, -18.83, 2.74, [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368]),
    "ct": (-2.89, -16.18, 0.70, [3.2512, 1.6047, 0.049588], [2.5261, 0.61654, -0.37956, -0.060285]),
}
# MacKinnon (2010) 5 % points as polynomials in 1/n.
MACKINNON_5PCT = {
    "n": [-1.94100, -0.2686, -3.365, 31.223],
    "c": [-2.86154, -2.8903, -4.234, -40.040],
    "ct": [-3.41049, -4.3904, -9.036, -45.374],
}


def normal_two_sided(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2.0))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def chi2_sf(x: float, df: float) -> float:
    """Upper regularised incomplete gamma function at (df/2, x/2)."""
    if not (x > 0):
        return 1.0 if x == x else math.nan
    a, x = df / 2.0, x / 2.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_sf(x: float, d1: float, d2: float) -> float:
    if not (x > 0):
        return 1.0 if x == x else math.nan
    return beta_cdf(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def f_critical(alpha: float, d1: float, d2: float) -> float:
    lo, hi = 0.0, 1.0
    while f_sf(hi, d1, d2) > alpha:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f_sf(mid, d1, d2) > alpha else (lo, mid)
    return (lo + hi) / 2


def mackinnon_p(stat: float, trend: str) -> float:
    switch, low, high, small, large = MACKINNON[trend]
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    return normal_cdf(float(np.polyval((small if stat <= switch else large)[::-1], stat)))


def mackinnon_5pct(trend: str, n: int) -> float:
    return float(np.polyval(MACKINNON_5PCT[trend][::-1], 1.0 / n))


def kpss_p(stat: float, trend: str) -> float:
    return float(np.interp(stat, KPSS_POINTS[trend], KPSS_P))
