"""Small Column helpers shared by all operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(column: Column | str, places: int = 8) -> Column:
    """Half-up rounding by floor, bit-identical in any IEEE engine.

    Values too large to scale into a long are returned unchanged.
    """
    c = F.col(column) if isinstance(column, str) else column
    unit = 10.0**places
    return F.when(F.abs(c) < 9e17 / unit, F.floor(c * unit + 0.5) / F.lit(unit)).otherwise(c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL, never an error or infinity, on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def finite(column: Column) -> Column:
    """NaN and infinities become NULL."""
    c = column.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def is_true(condition: Column) -> Column:
    """Three-valued to two-valued logic: an unknown comparison counts as false."""
    return F.coalesce(condition, F.lit(False))


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def guard(condition_bad: Column, message: str, value: Column, type_name: str) -> Column:
    """`value`, or a runtime error carrying `message` when `condition_bad` holds."""
    return F.when(condition_bad, F.raise_error(F.lit(message)).cast(type_name)).otherwise(value)


def _stirling_error(n: Column) -> Column:
    """log n! minus Stirling's leading terms: exact sum below 16, series above."""
    small = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(16.0)), F.lit(1.0)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + F.log(i.cast("double")),
    ) - ((n + 0.5) * F.log(n) - n + 0.5 * math.log(2 * math.pi))
    n2 = n * n
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / n2) / n2) / n2) / n
    return F.when(n < 16, small).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x*log(x/mean) + mean - x without cancellation near the mean."""
    d = (x - mean) / mean
    terms = [d ** j * ((-1) ** j / (j * (j - 1))) for j in range(2, 18)]
    near = mean * reduce(lambda a, b: a + b, terms)
    return F.when(F.abs(d) < 0.1, near).otherwise(x * F.log(x / mean) + mean - x)


def _binomial_pmf(k: Column, n: Column, p: Column) -> Column:
    """Saddle-point form of the binomial probability, accurate for any n."""
    q = 1.0 - p
    inner = F.exp(
        _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
        - _deviance(k, n * p) - _deviance(n - k, n * q)
    ) * F.sqrt(n / (2 * math.pi * k * (n - k)))
    return (
        F.when(k == 0, F.exp(n * F.log(q)))
        .when(k == n, F.exp(n * F.log(p)))
        .otherwise(inner)
    )


def binomial_upper_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), 0 < p < 1.

    Sums away from the mean by the ratio recurrence, so it needs O(sqrt(n)) terms:
    beyond 40 standard deviations every further term is below double precision.
    """
    k, n, p = k.cast("double"), n.cast("double"), p.cast("double")
    q = 1.0 - p
    width = F.ceil(40.0 * F.sqrt(n * p * q)).cast("double") + 60.0
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def tail(start, stop, step):
        return F.aggregate(
            F.when(start < stop, F.sequence((start + 1.0).cast("long"), stop.cast("long"))).otherwise(
                F.array().cast("array<bigint>")
            ),
            zero,
            lambda acc, i: F.struct(
                (acc["term"] * step(i.cast("double"))).alias("term"),
                (acc["total"] + acc["term"] * step(i.cast("double"))).alias("total"),
            ),
            lambda acc: acc["total"],
        )

    up = tail(k, F.least(n, k + width), lambda i: (n - i + 1.0) / i * (p / q))
    # Walking down from k-1: the i-th step goes from k-i to k-i-1 successes.
    below = k - 1.0
    steps = F.least(below, width)
    down = tail(F.lit(0.0), steps, lambda i: (below - i + 1.0) / (n - below + i) * (q / p))
    return (
        F.when(k <= 0, F.lit(1.0))
        .when(k >= n * p, F.least(F.lit(1.0), _binomial_pmf(k, n, p) * up))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - _binomial_pmf(below, n, p) * down))
    )
