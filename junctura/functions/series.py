"""Statistics of a short yearly count series held in separate columns.

The years are known when the plan is built, so every statistic is plain column
arithmetic: no arrays, no lambdas, all inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def slope(ys: list[Column]) -> Column:
    """Least-squares slope against the year index; 0 for fewer than two years."""
    n = len(ys)
    if n < 2:
        return F.lit(0.0)
    mid = (n - 1) / 2.0
    sxx = sum((i - mid) ** 2 for i in range(n))
    return _sum([y * F.lit((i - mid) / sxx) for i, y in enumerate(ys)])


def kendall_tau(ys: list[Column]) -> Column:
    """tau-b against time; 0 for a constant series or fewer than three years."""
    n = len(ys)
    if n < 3:
        return F.lit(0.0)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    s = _sum([F.signum((ys[j] - ys[i]).cast("double")) for i, j in pairs])
    ties = _sum([F.when(ys[j] == ys[i], 1).otherwise(0) for i, j in pairs])
    total = float(len(pairs))
    return F.coalesce(s / F.nullif(F.sqrt(F.lit(total) * (F.lit(total) - ties)), F.lit(0.0)), F.lit(0.0))


def changepoint(ys: list[Column], eps: float = 1e-6) -> Column:
    """Best Poisson log-likelihood gain over one split, squashed to (0, 1); 0 for
    fewer than four years. A constant series gives 1 / (1 + e)."""
    n = len(ys)
    if n < 4:
        return F.lit(0.0)

    def fit(total: Column, years: int) -> Column:
        return total * F.log(total / years + eps) - total

    head, tot = ys[0], _sum(ys)
    gains = []
    for k in range(1, n):
        gains.append(fit(head, k) + fit(tot - head, n - k) - fit(tot, n))
        if k < n - 1:
            head = head + ys[k]
    best = F.greatest(F.lit(0.0), *gains)
    return 1.0 / (1.0 + F.exp(1.0 - best))


def ewma_last(ys: list[Column], alpha: float) -> Column:
    """Last value of the exponentially weighted mean that starts at the first year."""
    n = len(ys)
    w = [(1 - alpha) ** (n - 1)] + [alpha * (1 - alpha) ** (n - 1 - i) for i in range(1, n)]
    return _sum([y * F.lit(wi) for y, wi in zip(ys, w)])


def velocity(ys: list[Column]) -> Column:
    return (ys[-1] - ys[0]).cast("double")


def acceleration(ys: list[Column]) -> Column:
    if len(ys) < 3:
        return F.lit(0.0)
    return ((ys[-1] - ys[-2]) - (ys[1] - ys[0])).cast("double")


def momentum(ys: list[Column]) -> Column:
    """Mean of the last two years over the mean of the first two; the late mean
    itself when the early one is zero; 0 for fewer than four years."""
    if len(ys) < 4:
        return F.lit(0.0)
    early, late = (ys[0] + ys[1]) / 2.0, (ys[-2] + ys[-1]) / 2.0
    return F.coalesce(late / F.nullif(early, F.lit(0.0)), late)
