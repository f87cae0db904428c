"""Distribution functions for finishing tests on tiny aggregate results.

Only ever applied to a handful of statistics (one per variable, model or
series) on the driver, or elementwise inside Arrow batches of bounded
samples. Standard algorithms: the normal CDF from ``math.erfc``, its inverse
by Halley refinement, regularized incomplete gamma (series / continued
fraction) and beta (Lentz continued fraction) functions.
"""

from __future__ import annotations

import math

import numpy as np

_SQRT2 = math.sqrt(2.0)
_SQRT2PI = math.sqrt(2.0 * math.pi)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / _SQRT2)


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / _SQRT2)


def norm_logcdf(x: float) -> float:
    c = norm_cdf(x)
    if c > 0:
        return math.log(c)
    # asymptotic expansion deep in the lower tail
    return -0.5 * x * x - math.log(-x) - 0.5 * math.log(2 * math.pi)


def norm_ppf(p: float) -> float:
    """Inverse normal CDF: logistic-type start, then Halley steps on erfc."""
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    if p == 0.5:
        return 0.0
    x = 4.91 * (p ** 0.14 - (1.0 - p) ** 0.14)
    for _ in range(50):
        e = norm_cdf(x) - p
        u = e * _SQRT2PI * math.exp(0.5 * x * x)
        step = u / (1.0 + 0.5 * x * u)
        x -= step
        if abs(step) < 1e-15 * max(1.0, abs(x)):
            break
    return x


def upper_tail(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(Z > x) and its logarithm for an array: the power series of the normal
    integral near zero, the continued fraction of Mills' ratio far out, both
    carried to double precision."""
    x = np.asarray(x, dtype=float)
    a = np.abs(x)
    near = a < 3.0
    dens = np.exp(-0.5 * a * a) / _SQRT2PI
    t = np.where(near, a, 0.0)
    term, total = t.copy(), t.copy()
    for k in range(1, 60):
        term = term * t * t / (2 * k + 1)
        total += term
    t = np.where(near, 3.0, a)
    frac = t.copy()
    for k in range(100, 0, -1):
        frac = t + k / frac
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = np.where(near, 0.5 - dens * total, dens / frac)
        log = np.where(near, np.log(np.maximum(tail, 1e-300)), -0.5 * a * a - math.log(_SQRT2PI) - np.log(frac))
    return np.where(x >= 0, tail, 1.0 - tail), np.where(x >= 0, log, np.log1p(-tail))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal CDF of an array with 0 < p < 1: Halley steps in the nearer
    tail, from the rational start of Abramowitz & Stegun 26.2.23 (4.5e-4 off)."""
    p = np.asarray(p, dtype=float)
    small = np.minimum(p, 1.0 - p)
    t = np.sqrt(-2.0 * np.log(small))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t ** 3)
    for _ in range(3):
        u = (upper_tail(x)[0] - small) * _SQRT2PI * np.exp(0.5 * x * x)
        x = x + u / (1.0 - 0.5 * x * u)
    return np.where(p < 0.5, -x, x)


def gammainc_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x < 0 or a <= 0:
        return math.nan
    if x == 0:
        return 1.0
    lg = math.lgamma(a)
    if x < a + 1.0:
        # series for P(a, x)
        term = total = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - lg))
    # continued fraction for Q(a, x) (modified Lentz)
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - lg) * h


def chi2_sf(x: float, df: float) -> float:
    if x is None or df is None or df <= 0 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    return gammainc_upper(df / 2.0, x / 2.0)


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t."""
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2.0, 0.5, x)
    return tail if t > 0 else 1.0 - tail


def t_two_sided(t: float, df: float) -> float:
    return 2.0 * t_sf(abs(t), df)


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if f <= 0:
        return 1.0
    x = d2 / (d2 + d1 * f)
    return betainc(d2 / 2.0, d1 / 2.0, x)
