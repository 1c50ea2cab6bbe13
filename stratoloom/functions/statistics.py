"""Critical values and p values that Spark has no functions for, on the driver, and the logarithm of gamma as a column."""

from __future__ import annotations

import math
from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(x: float, dof: int) -> float:
    """P(chi squared of ``dof`` degrees > x): a finite sum over half or whole powers."""
    if x <= 0:
        return 1.0
    half, term = x / 2, 0.0
    if dof % 2 == 0:
        return math.exp(-half) * math.fsum(math.exp(k * math.log(half) - math.lgamma(k + 1)) for k in range(dof // 2))
    term = math.erfc(math.sqrt(half))
    return term + math.fsum(math.exp(-half + (k + 0.5) * math.log(half) - math.lgamma(k + 1.5)) for k in range((dof - 1) // 2))


def chi2_critical(dof: int, alpha: float = 0.05) -> float:
    """The x that chi squared exceeds with probability ``alpha``, by bisection."""
    low, high = 0.0, 10.0 * dof + 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > alpha else (low, mid)
    return (low + high) / 2


def signed_rank_tail(w: float, n: int) -> float:
    """P(W+ >= w) of the signed-rank statistic of n untied differences: exact by counting subsets up to 50, then normal."""
    if n == 0:
        return 1.0
    top = n * (n + 1) // 2
    if n <= 50:
        ways = [1] + [0] * top
        for rank in range(1, n + 1):
            for s in range(top, rank - 1, -1):
                ways[s] += ways[s - rank]
        return sum(ways[math.ceil(w) :]) / 2**n
    z = (w - top / 2 - 0.5) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return math.erfc(z / math.sqrt(2)) / 2


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of positive numbers: Stirling's series eight steps up, and back down."""
    up = x + 8
    series = 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up) - 1 / (1680 * up * up * up * up * up * up * up)
    down = fold(lambda a, b: a + b, [F.log(x + i) for i in range(8)])
    return (up - 0.5) * F.log(up) - up + 0.9189385332046727 + series - down
