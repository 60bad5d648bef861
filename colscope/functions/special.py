"""Distribution tails in plain Python, for p-values of a few thousand tests at most."""

from __future__ import annotations

import math


def _continued(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_regularised(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued(a, b, x) / a
    return 1 - front * _continued(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def p_correlation(r: float, n: int) -> float | None:
    """Two-sided, from Student's t with n - 2 degrees of freedom."""
    if n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    v = n - 2
    t2 = r * r * v / (1 - r * r)
    return beta_regularised(v / 2, 0.5, v / (v + t2))


def p_f(f: float, d1: int, d2: int) -> float | None:
    if d1 < 1 or d2 < 1:
        return None
    return 0.0 if math.isinf(f) else beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def p_chi2(x: float, dof: int) -> float | None:
    return gamma_upper(dof / 2, x / 2) if dof > 0 else None


def p_kendall(tau: float, n: int) -> float | None:
    """Normal approximation."""
    if n < 2:
        return None
    return math.erfc(abs(tau) / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))) / math.sqrt(2))


def benjamini_hochberg(p: list[float | None], alpha: float) -> list[bool | None]:
    """Which hypotheses are rejected at false discovery rate ``alpha``; None stays None and does not count."""
    ranked = sorted((v, i) for i, v in enumerate(p) if v is not None)
    last = max((k for k, (v, _) in enumerate(ranked, 1) if v <= k / len(ranked) * alpha), default=0)
    out: list[bool | None] = [None if v is None else False for v in p]
    for _, i in ranked[:last]:
        out[i] = True
    return out
