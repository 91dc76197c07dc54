"""Statistics over counts: intervals and tests as columns, and the seeded resampling steps on small driver tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(k: Column, n: Column, empty: float | None = 0.0) -> Column:
    """``k / n``; where n is 0, ``empty`` (NaN for measures that don't exist then)."""
    return F.when(n > 0, k / n).otherwise(F.lit(empty))


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within 0 and 1; (0, 0) without trials. Counts must satisfy 0 <= k <= n."""
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must be between 0 and 1, not {confidence}")
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    trials = F.when(n > 0, n.cast("double"))
    p = k / trials
    wide = 1 + z * z / trials
    centre = (p + z * z / (2 * trials)) / wide
    half = F.lit(z) / wide * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    ok = F.when((k < 0) | (k > n), F.raise_error(F.lit("a Wilson interval needs 0 <= k <= n")).cast("double")).otherwise(F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)) + ok, F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(0.0)) + ok


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """Statistic and exact two-sided p-value of the discordant counts; (0, 1) without any.

    The tail is summed in logarithms, from term to term, so that large counts neither overflow nor vanish, and over a number
    of terms that grows with the square root of the counts.
    """
    n, low = (b + c).cast("double"), F.least(b, c).cast("long")
    first = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    # terms shrink towards 0 from the last one down, so those more than ``WIDEST`` standard deviations below n / 2 add nothing
    start = F.greatest(F.lit(1).cast("long"), F.floor(n / 2 - WIDEST * F.sqrt(n) / 2))
    log_term = lambda k: _log_factorial(n) - _log_factorial(k.cast("double")) - _log_factorial(n - k) - n * F.log(F.lit(2.0))
    far = F.struct(log_term(start - 1).alias("term"), F.exp(log_term(start - 1)).alias("sum"))
    steps = F.when(low >= start, F.sequence(start, F.greatest(low, start))).otherwise(F.array().cast("array<bigint>"))

    def more(s: Column, k: Column) -> Column:
        term = s["term"] + F.log(n - k + 1) - F.log(k.cast("double"))
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(steps, F.when(start > 1, far).otherwise(first), more, lambda s: s["sum"])
    tail = F.when((low < start) & (start > 1), F.lit(0.0)).otherwise(tail)
    return F.when(n == 0, F.lit(0.0)).otherwise(b.cast("double")), F.when((n == 0) | (b == c), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


#: Standard deviations of the binomial whose tail beyond them is below 1e-300.
WIDEST = 40


def _log_factorial(n: Column) -> Column:
    """Stirling's series; only used for large counts."""
    m = F.greatest(n, F.lit(1.0))
    return m * F.log(m) - m + F.log(2 * math.pi * m) / 2 + 1 / (12 * m) - 1 / (360 * m * m * m)


def mcnemar_exact(b: int, c: int) -> tuple[float, float]:
    """The same on two plain counts."""
    if min(b, c) < 0:
        raise ValueError("counts can't be negative")
    n = b + c
    return (float(b), min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)) if n else (0.0, 1.0)


def folded_bootstrap(kinds: list[tuple[int, int, int]], confidence: float = 0.95, resamples: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of pooled accuracy when whole clusters are resampled; (0, 0) without cases.

    ``kinds``: (correct, size, clusters of that kind). How often each kind is drawn is multinomial, so a resample costs a
    draw for each kind, whatever the number of clusters.
    """
    if not 0 < confidence < 1 or resamples < 1:
        raise ValueError("confidence must be between 0 and 1, and resamples 1 or more")
    correct, size, n = (np.array(x, np.int64) for x in zip(*kinds, strict=True)) if kinds else (np.zeros(0, np.int64),) * 3
    if not (size * n).sum():
        return 0.0, 0.0
    rng, some, accuracy = np.random.default_rng(seed), max(1, 4_000_000 // len(n)), np.empty(resamples)
    for i in range(0, resamples, some):
        drawn = rng.multinomial(n.sum(), n / n.sum(), size=min(some, resamples - i))
        accuracy[i : i + some] = (drawn @ correct) / np.maximum(drawn @ size, 1)
    edge = (1 - confidence) / 2 * 100
    return float(np.percentile(accuracy, edge)), float(np.percentile(accuracy, 100 - edge))


def cluster_bootstrap(correct: list[int], sizes: list[int], confidence: float = 0.95, resamples: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of pooled accuracy when whole clusters are resampled; (0, 0) without cases.

    Takes a count of correct cases and of cases for each cluster. Draws come from PCG64 with the given seed.
    """
    if not 0 < confidence < 1 or resamples < 1:
        raise ValueError("confidence must be between 0 and 1, and resamples 1 or more")
    if not sum(sizes):
        return 0.0, 0.0
    hits, cases = np.asarray(correct, np.int64), np.asarray(sizes, np.int64)
    rng, some, accuracy = np.random.default_rng(seed), max(1, 4_000_000 // len(hits)), np.empty(resamples)
    for i in range(0, resamples, some):  # the same draws as all at once, in bounded memory
        chosen = rng.integers(0, len(hits), size=(min(some, resamples - i), len(hits)))
        accuracy[i : i + some] = hits[chosen].sum(axis=1) / cases[chosen].sum(axis=1)
    edge = (1 - confidence) / 2 * 100
    return float(np.percentile(accuracy, edge)), float(np.percentile(accuracy, 100 - edge))
