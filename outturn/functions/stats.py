"""Tail probabilities of single numbers, on the driver."""

from __future__ import annotations

import math


def chi_square_tail(x: float, degrees: int) -> float:
    """P(X > x) for a chi-square variable with a whole number of degrees of freedom.

    Closed forms: a Poisson tail for even degrees, the normal tail plus a finite sum for
    odd ones.
    """
    if x <= 0:
        return 1.0
    half = x / 2
    if degrees % 2 == 0:
        terms = [half**i / math.factorial(i) for i in range(degrees // 2)]
        return math.exp(-half) * sum(terms)
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(half) / math.gamma(1.5)
    for i in range(degrees // 2):
        total += math.exp(-half) * term
        term *= half / (i + 1.5)
    return total
