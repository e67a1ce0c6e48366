"""Accuracy measures as aggregate expressions over prepared columns.

A measure is a function of :class:`Inputs`; all measures asked for are evaluated
in one aggregation.  Missing means null or NaN; means skip it; an empty mean
is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import clean, divide, normal_cdf, normal_pdf, sample_quantile, sorted_quantile, z_of


@dataclass(frozen=True)
class Inputs:
    """Columns of a scored row. e: actual less point forecast; dy: actual less the actual before; e_before: e of the row
    before; abs_scale, sq_scale: mean absolute and squared (seasonal) difference of the training series."""

    e: Column
    y: Column
    fc: Column
    dy: Column
    e_before: Column
    mu: Column
    sigma: Column
    sample: Column | None
    abs_scale: Column
    sq_scale: Column
    back: Callable[[Column], Column]
    #: Whether the row's distribution is a transformed one, and not normal on the response scale.
    moved: Column | None = None
    #: Gets the options of the scales that measures ask for beside the two above.
    asked: set[tuple[bool, int | None, int | None]] | None = None

    def scale(self, kind: str, demean: bool = False, d: int | None = None, D: int | None = None) -> Column:
        """Mean absolute (``abs``) or squared (``sq``) value of the training series after D seasonal and d first
        differences, ``demean`` less its mean; by default one difference, seasonal where the period is over 1."""
        if (demean, d, D) == (False, None, None):
            return self.abs_scale if kind == "abs" else self.sq_scale
        if self.asked is not None:
            self.asked.add((demean, d, D))
        return F.col(f"{kind}_scale_{int(demean)}_{d}_{D}")

    def quantile(self, p: float) -> Column:
        normal = self.back(self.mu + z_of(p) * self.sigma)
        return normal if self.sample is None else F.when(self.sample.isNotNull(), sample_quantile(self.sample, p)).otherwise(normal)


Measure = Callable[[Inputs], Column]


def _mean(x: Column) -> Column:
    return F.avg(clean(x))


def ME(i: Inputs) -> Column:
    return _mean(i.e)


def MSE(i: Inputs) -> Column:
    return _mean(i.e * i.e)


def RMSE(i: Inputs) -> Column:
    return F.sqrt(MSE(i))


def MAE(i: Inputs) -> Column:
    return _mean(F.abs(i.e))


def MPE(i: Inputs) -> Column:
    """Rows with an actual of zero are left out."""
    return _mean(100 * divide(i.e, i.y))


def MAPE(i: Inputs) -> Column:
    return _mean(F.abs(100 * divide(i.e, i.y)))


def MAAPE(i: Inputs) -> Column:
    """Mean arctangent absolute percentage error; an actual of zero with an error counts as pi / 2."""
    return _mean(F.when((i.y == 0) & (i.e != 0), math.pi / 2).otherwise(F.atan(F.abs(100 * divide(i.e, i.y)))))


def MASE(i: Inputs, demean: bool = False, d: int | None = None, D: int | None = None) -> Column:
    return _mean(F.abs(divide(i.e, i.scale("abs", demean, d, D))))


def RMSSE(i: Inputs, demean: bool = False, d: int | None = None, D: int | None = None) -> Column:
    return F.sqrt(_mean(divide(i.e * i.e, i.scale("sq", demean, d, D))))


def ACF1(i: Inputs) -> Column:
    """Lag-one autocorrelation of the errors; null for one row."""
    e, b = clean(i.e), clean(i.e_before)
    m, both = F.avg(e), e.isNotNull() & b.isNotNull()
    over = F.sum(F.when(both, e * b)) - m * (F.sum(F.when(both, e)) + F.sum(F.when(both, b))) + F.sum(both.cast("int")) * m * m
    return F.when(F.count(e) > 1, divide(over, F.sum(e * e) - F.count(e) * m * m))


def _right_way(i: Inputs) -> Column:
    return F.signum(i.dy) == F.signum(i.dy - i.e)


def MDA(i: Inputs, reward: float = 1, penalty: float = 0) -> Column:
    """How often the change went the way that was forecast."""
    return (reward - penalty) * F.avg(_right_way(i).cast("double")) + penalty


def MDV(i: Inputs) -> Column:
    return _mean(F.abs(i.dy) * F.when(_right_way(i), 1.0).otherwise(F.when(_right_way(i).isNotNull(), -1.0)))


def MDPV(i: Inputs) -> Column:
    return 100 * _mean(F.abs(divide(i.dy, i.y)) * F.when(_right_way(i), 1.0).otherwise(F.when(_right_way(i).isNotNull(), -1.0)))


def winkler_score(i: Inputs, level: float = 95) -> Column:
    a = 1 - level / 100
    low, high = i.quantile(a / 2), i.quantile(1 - a / 2)
    out = F.when(i.y < low, (low - i.y) * 2 / a).when(i.y > high, (i.y - high) * 2 / a).otherwise(F.when(i.y.isNotNull(), 0.0))
    return _mean(high - low + out)


def _pinball(i: Inputs, p: float) -> Column:
    q = i.quantile(p)
    return F.when(i.y >= q, p * (i.y - q)).otherwise((1 - p) * (q - i.y))


def pinball_loss(i: Inputs, level: float = 95) -> Column:
    return 2 * _mean(_pinball(i, level / 100))


def scaled_pinball_loss(i: Inputs, level: float = 95, demean: bool = False, d: int | None = None, D: int | None = None) -> Column:
    return _mean(divide(_pinball(i, level / 100), i.scale("abs", demean, d, D)))


def quantile_score(i: Inputs, probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> Column:
    return 2 * sum((_mean(_pinball(i, p)) for p in probs), F.lit(0.0)) / len(probs)


def _mean_pinball(i: Inputs, levels: list[float], quantile: Callable[[Column], Column]) -> Column:
    """Twice the mean pinball loss of a row over levels; they are an array of (p, z), so that the plan stays small."""
    z = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(z_of(p)).alias("z")) for p in levels])

    def add(acc: Column, x: Column) -> Column:
        q = quantile(x)
        return acc + F.when(i.y >= q, x["p"] * (i.y - q)).otherwise((1 - x["p"]) * (q - i.y))

    return 2 * F.aggregate(z, F.lit(0.0), add) / len(levels)


def percentile_score(i: Inputs) -> Column:
    """Mean pinball loss over 99 levels."""
    levels = [k / 100 for k in range(1, 100)]
    normal = _mean_pinball(i, levels, lambda x: i.back(i.mu + x["z"] * i.sigma))
    if i.sample is None:
        return _mean(normal)
    drawn = F.element_at(F.transform(F.array(F.array_sort(i.sample)), lambda s: _mean_pinball(i, levels, lambda x: sorted_quantile(s, x["p"]))), 1)
    return _mean(F.when(i.sample.isNotNull(), drawn).otherwise(normal))


def CRPS(i: Inputs, n_quantiles: int = 1000) -> Column:
    """Normal: closed form; sample: sorted draws; transformed: the mean quantile score over ``n_quantiles`` even levels."""
    z = divide(i.y - i.mu, i.sigma)
    closed = F.when(i.sigma > 0, i.sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))).otherwise(F.abs(i.y - i.fc))
    if i.moved is not None:
        levels = [k / (n_quantiles + 1) for k in range(1, n_quantiles + 1)]
        closed = F.when(i.moved, _mean_pinball(i, levels, lambda x: i.back(i.mu + x["z"] * i.sigma))).otherwise(closed)
    if i.sample is None:
        return _mean(closed)
    m = F.size(i.sample)
    rows = F.transform(F.array_sort(i.sample), lambda x, k: (x - i.y) * (m * (i.y < x).cast("double") - (k + 1) + 0.5))
    drawn = 2 * F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + x) / (m * m)
    return _mean(F.when(i.sample.isNotNull(), drawn).otherwise(closed))


point_accuracy_measures: Mapping[str, Measure] = {"ME": ME, "RMSE": RMSE, "MAE": MAE, "MPE": MPE, "MAPE": MAPE, "MASE": MASE, "RMSSE": RMSSE, "ACF1": ACF1}
directional_accuracy_measures: Mapping[str, Measure] = {"MDA": MDA, "MDV": MDV, "MDPV": MDPV}
interval_accuracy_measures: Mapping[str, Measure] = {"winkler": winkler_score, "pinball": pinball_loss, "scaled_pinball": scaled_pinball_loss}
distribution_accuracy_measures: Mapping[str, Measure] = {"percentile": percentile_score, "CRPS": CRPS}
#: Measures with other arguments: ``with_args(winkler_score, level=80)``.
with_args = partial
