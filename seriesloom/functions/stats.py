"""Column helpers: missing values, guarded division, the normal distribution, sample quantiles."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """Null for NaN as well: both are missing."""
    return F.when(~F.isnan(x), x)


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.when(b != 0, a / b)


def ieee_divide(a: Column, b: Column) -> Column:
    """As doubles do: infinite for a division by zero, NaN for 0 / 0."""
    inf = F.lit(math.inf)
    return F.when(b != 0, a / b).when(a > 0, inf).when(a < 0, -inf).when(a == 0, F.lit(math.nan))


def z_of(p: float) -> float:
    """Standard normal quantile of a literal level."""
    return NormalDist().inv_cdf(p)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """0.5 + pdf(x) * sum of x^(2k+1) / (1 * 3 * ... * (2k+1)): exact to double precision up to 7, flat beyond."""
    start = F.struct(x.cast("double").alias("s"), x.cast("double").alias("t"))

    def add(acc: Column, k: Column) -> Column:
        t = acc["t"] * x * x / (2 * k + 1)
        return F.struct((acc["s"] + t).alias("s"), t.alias("t"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, add, lambda acc: acc["s"])
    return F.when(x > 7, 1.0).when(x < -7, 0.0).otherwise(0.5 + normal_pdf(x) * total)


def sorted_quantile(s: Column, p: float | Column) -> Column:
    """Interpolated quantile (type 7) of a sorted array."""
    at = (F.size(s) - 1) * p
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return a + (at - low) * (b - a)


def sample_quantile(sample: Column, p: float) -> Column:
    """Interpolated quantile (type 7) of an array."""
    return sorted_quantile(F.array_sort(sample), p)


def sample_mean(sample: Column) -> Column:
    return F.aggregate(sample, F.lit(0.0), lambda acc, x: acc + x) / F.size(sample)


def box_cox(x: Column, lam: float | Column) -> Column:
    """log for lambda 0, else (sign(x) |x|^lambda - 1) / lambda; negative x with a negative lambda are missing."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    power = (F.signum(x) * F.pow(F.abs(x), lam) - 1) / F.when(lam == 0, 1.0).otherwise(lam)
    return F.when(lam == 0, F.ln(x)).when((lam < 0) & (x < 0), F.lit(None).cast("double")).otherwise(power)


def inv_box_cox(x: Column, lam: float | Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    safe = F.when(lam == 0, 1.0).otherwise(lam)
    z = x * lam + 1
    return F.when(lam == 0, F.exp(x)).when((lam < 0) & (x > -1 / safe), F.lit(None).cast("double")).otherwise(F.signum(z) * F.pow(F.abs(z), 1 / safe))
