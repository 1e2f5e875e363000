"""Distributions as column expressions: they run inside the plan, for each row, without Python."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation of erf (Abramowitz and Stegun 7.1.26), from the lowest power up.
ERF = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
ERF_T = 0.3275911
# Acklam's rational approximations of the normal quantile, from the highest power down.
MIDDLE = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.38357751867269e2, -3.066479806614716e1, 2.506628277459239]
UNDER_MIDDLE = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0]
TAIL = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
UNDER_TAIL = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0]
TAIL_BELOW = 0.02425
# Lanczos's coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
#: Steps of the series and of the continued fraction; both have settled long before for the sizes that tests of proportions have.
STEPS = 300


def _horner(x: Column, falling: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), falling[1:], F.lit(falling[0]))


def erf(x: Column) -> Column:
    a = F.abs(x)
    t = 1 / (1 + ERF_T * a)
    return F.signum(x) * (1 - t * _horner(t, ERF[::-1]) * F.exp(-a * a))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def normal_quantile(p: Column) -> Column:
    """Infinite at 0 and 1 and beyond; null for null."""
    tail = lambda side: F.sqrt(-2 * F.log(side))
    outer = lambda q: _horner(q, TAIL) / _horner(q, UNDER_TAIL)
    q = p - 0.5
    inner = q * _horner(q * q, MIDDLE) / _horner(q * q, UNDER_MIDDLE)
    return (
        F.when(p.isNull(), None).when(p <= 0, F.lit(-math.inf)).when(p >= 1, F.lit(math.inf))
        .when(p < TAIL_BELOW, outer(tail(p))).when(p <= 1 - TAIL_BELOW, inner).otherwise(-outer(tail(1 - p)))
    )


def _log_gamma_above(x: Column) -> Column:
    """ln of gamma from a half on."""
    total = reduce(lambda acc, i: acc + LANCZOS[i] / (x - 1 + i), range(1, 9), F.lit(LANCZOS[0]))
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(x + 6.5) - (x + 6.5) + F.log(total)


def log_gamma(x: Column) -> Column:
    """ln of gamma for positive numbers."""
    return F.when(x < 0.5, F.log(math.pi / F.sin(math.pi * x)) - _log_gamma_above(1 - x)).otherwise(_log_gamma_above(x))


def gamma_q(s: Column, x: Column, steps: int = STEPS) -> Column:
    """Regularised upper incomplete gamma: one less the series below s + 1, else the continued fraction."""
    s, x = s.cast("double"), x.cast("double")
    scale = F.exp(-x + s * F.log(x) - log_gamma(s))
    step = F.sequence(F.lit(1), F.lit(steps))
    series = F.aggregate(step, F.struct((1 / s).alias("term"), (1 / s).alias("sum")), lambda a, i: F.struct((a["term"] * x / (s + i)).alias("term"), (a["sum"] + a["term"] * x / (s + i)).alias("sum")))["sum"]

    def lentz(a: Column, i: Column) -> Column:
        over, under = -i * (i - s), x + 1 - s + 2 * i
        d = 1 / (over * a["d"] + under)
        c = under + over / a["c"]
        return F.struct(c.alias("c"), d.alias("d"), (a["h"] * c * d).alias("h"))

    first = 1 / (x + 1 - s)
    fraction = F.aggregate(step, F.struct(F.lit(1e30).alias("c"), first.alias("d"), first.alias("h")), lentz)["h"]
    return F.when(s.isNull() | x.isNull(), None).when(x <= 0, F.lit(1.0)).when(x < s + 1, 1 - scale * series).otherwise(scale * fraction)


def chi_square_sf(x: Column, df: Column) -> Column:
    """Share of a chi-square distribution above x."""
    return gamma_q(df / 2, x / 2)


def log_choose(n: Column, k: Column) -> Column:
    return F.when((k < 0) | (k > n), F.lit(-math.inf)).otherwise(_log_gamma_above(n + 1) - _log_gamma_above(k + 1) - _log_gamma_above(n - k + 1))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Chance that a fair coin shows, in n throws, a count at least as far from n/2 as k. One term for each count up to the smaller side: for small n."""
    k, n = k.cast("double"), n.cast("double")
    tail = F.aggregate(F.sequence(F.lit(0), F.least(k, n - k).cast("int")), F.lit(0.0), lambda acc, i: acc + F.exp(log_choose(n, i.cast("double")) - n * math.log(2)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
