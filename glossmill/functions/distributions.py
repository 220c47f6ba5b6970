"""Distribution functions for p-values, in plain Python; one call for each metric, never for each row."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution by bisection."""
    if not 0 < p < 1:
        raise ValueError("p must be between 0 and 1")
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if normal_cdf(middle) < p else (low, middle)
    return (low + high) / 2


def _fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + top * d) or tiny)
        c = (1 + top / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return f - 1


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    return front * _fraction(x, a, b) / a


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def binomial_greater(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else incomplete_beta(p, k, n - k + 1)


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact test on the discordant counts."""
    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * (1 - binomial_greater(min(b, c) + 1, n)))


def ks_two_sided(statistic: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    x = statistic * math.sqrt(n * m / (n + m))
    if x <= 0:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def sample_size(power: float, delta: float, sigma: float, alpha: float = 0.05) -> int:
    """Pairs needed to see a difference ``delta`` with that power."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return math.ceil((z * sigma / delta) ** 2)
