"""Scalar statistics that need no table."""

from __future__ import annotations

import math


def t_cdf(t: float, df: int) -> float:
    """Student t distribution function for integer degrees of freedom, by the finite trigonometric series."""
    theta = math.atan2(t, math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df % 2:
        term, acc = c, 0.0
        for i in range(1, df - 1, 2):
            acc += term
            term *= c * c * (i + 1) / (i + 2)
        area = 2 / math.pi * (theta + (s * acc if df > 1 else 0.0))
    else:
        term, acc = 1.0, 0.0
        for i in range(0, df - 1, 2):
            acc += term
            term *= c * c * (i + 1) / (i + 2)
        area = s * acc
    return 0.5 + area / 2


def t_quantile(p: float, df: int) -> float:
    """Inverse of ``t_cdf`` by bisection; exact to double rounding."""
    if df < 1:
        raise ValueError(f"the t distribution needs a degree of freedom, not {df}")
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2
