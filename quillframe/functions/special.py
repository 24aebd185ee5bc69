"""Distribution functions, on the driver."""

from __future__ import annotations

import math

NORMAL_A = 0.147


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_cdf_closed(x: float) -> float:
    """By Winitzki's closed form of erf, off by up to about 1e-4; the same expression runs as a column."""
    z = x / math.sqrt(2)
    s = z * z
    return 0.5 * (1 + math.copysign(math.sqrt(1 - math.exp(-s * (4 / math.pi + NORMAL_A * s) / (1 + NORMAL_A * s))), z))


def regularized_gamma(a: float, x: float) -> float:
    """The lower incomplete gamma function over gamma: a series below a + 1, else a continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - h * scale


def regularized_beta(x: float, a: float, b: float) -> float:
    """The incomplete beta function over beta, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - regularized_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for factor in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + factor * d or tiny)
            c = 1 + factor / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - regularized_gamma(df / 2, x / 2)


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return regularized_beta(df / (df + t * t), df / 2, 0.5)


def t_cdf(t: float, df: float) -> float:
    tail = t_sf2(t, df) / 2
    return 1 - tail if t > 0 else tail


def chi2_cdf(x: float, df: float) -> float:
    return regularized_gamma(df / 2, x / 2)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 1 - f_sf(x, d1, d2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else regularized_beta(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def kolmogorov_sf(x: float) -> float:
    if x <= 0:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 200))))
