"""Upper tails and combinations of p-values, without scipy."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _gamma_fraction(a: float, x: float) -> float:
    """Continued fraction of the upper incomplete gamma function."""
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def chi2_sf(x: float, df: float) -> float:
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x >= a + 1:
        return front * _gamma_fraction(a, x)
    term = total = 1 / a
    k = a
    while abs(term) > abs(total) * 1e-17:
        k += 1
        term *= x / k
        total += term
    return 1 - total * front


def chi2_quantile(q: float, df: float) -> float:
    """Where the lower tail is ``q``, by Newton steps kept within a shrinking bracket."""
    if not 0 < q < 1:
        raise ValueError("a probability strictly between 0 and 1 is needed")
    a, low, high = df / 2, 0.0, df + 1.0
    while chi2_sf(high, df) > 1 - q:
        low, high = high, 2 * high
    x = (low + high) / 2
    for _ in range(200):
        over = 1 - chi2_sf(x, df) - q
        low, high = (low, x) if over > 0 else (x, high)
        density = math.exp((a - 1) * math.log(x / 2) - x / 2 - math.lgamma(a)) / 2
        new = x - over / density if density else low
        new = new if low < new < high else (low + high) / 2
        if abs(new - x) <= 1e-14 * x:
            break
        x = new
    return x


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 2000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x > 0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_sf(x: float, df1: float, df2: float) -> float:
    return 1.0 if x <= 0 else beta_cdf(df2 / (df2 + df1 * x), df2 / 2, df1 / 2)


def gumbel_sf(g: float, scale: float = 1.0) -> float:
    """Tail of exp(-exp(-g/2) / sqrt(pi) * scale)."""
    return -math.expm1(-scale * math.exp(-g / 2) / math.sqrt(math.pi))


def cauchy_combination(*p: float) -> float:
    """Equal-weight Cauchy combination; p-values of exactly 0 and 1 contradict."""
    if 0.0 in p and 1.0 in p:
        raise ValueError("p-values of 0 and 1 cannot be combined")
    if 0.0 in p or 1.0 in p:
        return 0.0 if 0.0 in p else 1.0
    t = sum(math.tan((0.5 - x) * math.pi) if x > 1e-15 else 1 / (x * math.pi) for x in p) / len(p)
    return 0.5 - math.atan(t) / math.pi if t < 1e15 else 1 / (t * math.pi)


def truncated_cauchy(*p: float) -> float:
    """Only p-values below 1/2 take part; without any, 1/2."""
    t = sum(math.tan((0.5 - x) * math.pi) for x in p if x < 0.5) / len(p)
    return 0.5 - math.atan(t) / math.pi


def fisher_two(p: float, q: float) -> float:
    """Fisher's combination of two p-values, in closed form."""
    s = -2 * (math.log(p) + math.log(q)) if p > 0 and q > 0 else math.inf
    return math.exp(-s / 2) * (1 + s / 2) if s < math.inf else 0.0
