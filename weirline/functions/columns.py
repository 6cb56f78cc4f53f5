"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_total(names) -> Column:
    """Sum over columns where a missing value counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in names])


def not_below_zero(c) -> Column:
    """max(c, 0), keeping a missing value missing (greatest() would skip it)."""
    c = col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def zero_becomes(c, tiny: float) -> Column:
    c = col(c)
    return F.when(c == 0, F.lit(tiny)).otherwise(c)


def at_least(c, low: float) -> Column:
    c = col(c)
    return F.when(c < low, F.lit(low)).otherwise(c)


def season_phase(date) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * (F.month(col(date)).cast("double") - 1) / F.lit(12.0)
    return F.sin(angle), F.cos(angle)


def squashed_score(x, mean, sd) -> Column:
    """tanh of a z-score; the small constant keeps the divisor away from 0."""
    return F.tanh((col(x) - col(mean)) / (col(sd) + F.lit(1e-6)))


def curve_position(x, grid) -> Column:
    """Where x lies on an ascending grid of quantiles, as a share in [0, 1].

    Linear between grid points; below the grid 0, at or beyond its end 1. Equal
    grid points resolve to the last of them, so the divisor is never 0.
    """
    x, grid = col(x), col(grid)
    steps = F.size(grid) - 1
    j = F.size(F.filter(grid, lambda g: g <= x)) - 1
    left, right = F.get(grid, j), F.get(grid, j + 1)
    inside = (j + (x - left) / (right - left)) / steps
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(j < 0, F.lit(0.0))
        .when(j >= steps, F.lit(1.0))
        .otherwise(inside)
    )


def harmonic(a, b, clamp: float | None = None, eps: float = 0.0) -> Column:
    """Harmonic mean of two scores.

    ``clamp`` lifts both to at least that value first; ``eps`` is added to the
    denominator. Without a clamp, opposite signs near a zero sum blow up, so the
    clamped form is the recommended one.
    """
    a, b = col(a), col(b)
    if clamp is not None:
        a, b = at_least(a, clamp), at_least(b, clamp)
    bottom = a + b + F.lit(eps)
    return F.when(bottom != 0, F.lit(2.0) * a * b / bottom)


# The four scoring rules in use.
HMEAN_GRID = {"clamp": 1e-6, "eps": 0.0}
HMEAN_GREEDY = {"clamp": 1e-9, "eps": 0.0}
HMEAN_TOP = {"clamp": None, "eps": 1e-6}
HMEAN_TEST = {"clamp": None, "eps": 1e-12}


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def softmax(logits, tau: float = 1.0) -> Column:
    def shares(raised: Column) -> Column:
        total = F.aggregate(raised, F.lit(0.0), lambda acc, v: acc + v)
        return bind(total, lambda t: F.transform(raised, lambda v: v / t))

    def raise_all(values: Column) -> Column:
        return bind(
            F.array_max(values), lambda top: F.transform(values, lambda v: F.exp((v - top) / F.lit(tau)))
        )

    return bind(bind(col(logits), raise_all), shares)


def weighted_sum(weights, values) -> Column:
    return F.aggregate(
        F.zip_with(col(weights), col(values), lambda w, v: w * v),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def array_mean(values) -> Column:
    values = col(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def weight_entropy(weights) -> Column:
    return -F.aggregate(
        col(weights), F.lit(0.0), lambda acc, w: acc + w * F.ln(w + F.lit(1e-12))
    )


def strongest(weights) -> Column:
    """0-based index of the largest weight."""
    weights = col(weights)
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)
