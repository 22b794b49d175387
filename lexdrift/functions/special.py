"""Distribution functions as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction; it settles after some root of the degrees of freedom, so that many do up to a million.
STEPS = 2000
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Of positive numbers: Stirling's series at x + 8, brought back by the recurrence; exact to about 1e-12."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)) + 1 / (1188 * F.pow(z, 9))
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    off_zero = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    first = 1 / off_zero(1 - (a + b) * x / (a + 1))
    zero = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d1 = 1 / off_zero(1 + even * s["d"])
        c1 = off_zero(1 + even / s["c"])
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d2 = 1 / off_zero(1 + odd * d1)
        c2 = off_zero(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for 0 <= x <= 1, from whichever tail converges faster."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    near = front * beta_fraction(x, a, b) / a
    far = 1 - front * beta_fraction(1 - x, b, a) / b
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), near).otherwise(far)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of ``n`` pairs under independence, by Student's t with n - 2 degrees; null below three pairs."""
    d = (n - 2).cast("double")
    return F.when(n > 2, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(incomplete_beta(1 - r * r, d / 2, F.lit(0.5))))
