"""Tail probabilities as column expressions: continued fractions and series of a fixed number of terms, folded over an array of steps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation of the gamma function (g = 7, nine terms): fixed values.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
STEPS, TINY = 200, 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function, for x of at least one half."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + k)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)


def away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified method of Lentz; good for x below (a + 1) / (a + b + 2)."""
    first = 1 / away_from_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half(s: Column, term: Column) -> Column:
        d, c = 1 / away_from_zero(1 + term * s["d"]), away_from_zero(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def even(s: Column, m: Column) -> Column:
        return half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))

    def odd(s: Column, m: Column) -> Column:
        return half(s, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    # Terms take turns; one step a fold keeps the expression small.
    steps = F.sequence(F.lit(2), F.lit(STEPS + 1))

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        return F.when(k % 2 == 0, even(s, m)).otherwise(odd(s, m))

    return F.aggregate(steps, start, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for x in 0 to 1 and a, b of at least one half."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * beta_fraction(x, a, b) / a
    high = 1 - front * beta_fraction(1 - x, b, a) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability that |T| is at least |t| for Student's distribution."""
    return incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))


def chi_squared_tail(x: Column, df: Column) -> Column:
    """Probability that a chi-squared variable is at least x: one less a series where x is small, else a continued fraction."""
    a, z = df / 2, x / 2
    front = F.exp(a * F.log(z) - z - log_gamma(a))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * z / (a + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct((1 / a).alias("term"), (1 / a).alias("total")), add, lambda s: s["total"])
    b0 = z + 1 - a
    first = 1 / away_from_zero(b0)

    def lentz(s: Column, n: Column) -> Column:
        an, b = -n * (n - a), s["b"] + 2
        d, c = 1 / away_from_zero(an * s["d"] + b), away_from_zero(b + an / s["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(b0.alias("b"), F.lit(1 / TINY).alias("c"), first.alias("d"), first.alias("h")), lentz, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(z < a + 1, 1 - front * series).otherwise(front * fraction)
