"""Tail probabilities of F, Student t and Spearman's rho as Column expressions.

All three are regularised incomplete beta functions, whose continued fraction is folded over a fixed
sequence of steps (modified Lentz), so they run on the JVM inside any projection.
Stirling's series gives log-gamma after a shift to arguments of SHIFT or more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 600
SHIFT = 10
TINY = 1e-300
#: Coefficients of 1/y, 1/y^3, ... in Stirling's series (fixed values).
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: ln gamma(x + SHIFT) less the logarithm of the factors in between."""
    y = x + SHIFT
    series = F.lit(0.0)
    for c in reversed(STIRLING):
        series = series / (y * y) + c
    factors = F.lit(1.0)
    for i in range(SHIFT):
        factors = factors * (x + i)
    # the factors of a large x are near powers of it: their logarithm stays finite through ln x
    ratio = F.lit(1.0)
    for i in range(1, SHIFT):
        ratio = ratio * (1 + F.lit(float(i)) / x)
    logs = F.when(x < 1e20, F.log(factors)).otherwise(SHIFT * F.log(x) + F.log(ratio))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series / y - logs


def _off_zero(v: Column) -> Column:
    return F.when(F.abs(v) < TINY, TINY).otherwise(v)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, STEPS terms of it."""
    start = F.struct(F.lit(1 / TINY).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))

    def step(s: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(j % 2 == 0, even).otherwise(odd)
        d = 1 / _off_zero(1 + term * s["d"])
        c = _off_zero(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["h"]


def beta_inc(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta I_x(a, b); ``rest`` is 1 - x without the subtraction."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(rest))
    low = x < (a + 1) / (a + b + 2)             # there the fraction converges fast, elsewhere its mirror image
    p, q = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a)
    part = front * _fraction(p, q, F.when(low, x).otherwise(rest)) / p
    return (F.when(x <= 0, 0.0).when(rest <= 0, 1.0)
            .otherwise(F.when(low, part).otherwise(1 - part)))


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) for F(d1, d2); null without a statistic or a degree of freedom."""
    f, d1, d2 = (c.cast("double") for c in (f, d1, d2))
    whole = d2 + d1 * f
    known = f.isNotNull() & ~F.isnan(f) & (d1 > 0) & (d2 > 0)
    return F.when(known, F.when(f <= 0, 1.0).otherwise(beta_inc(d2 / 2, d1 / 2, d2 / whole, d1 * f / whole)))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided P(|T| > |t|) for Student t with ``df`` degrees of freedom; null if one is missing."""
    t, df = t.cast("double"), df.cast("double")
    whole = df + t * t
    known = t.isNotNull() & ~F.isnan(t) & (df > 0)
    return F.when(known, beta_inc(df / 2, F.lit(0.5), df / whole, t * t / whole))


def rho_p(rho: Column, n: Column) -> Column:
    """Two-sided p of Spearman's rho over n rows by its t statistic; null for n < 3."""
    rho, n = rho.cast("double"), n.cast("double")
    t = rho * F.sqrt((n - 2) / (1 - rho * rho))
    return F.when((n >= 3) & rho.isNotNull(),
                  F.when(F.abs(rho) >= 1, 0.0).otherwise(t_two_sided(t, n - 2)))
