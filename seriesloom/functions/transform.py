"""Transformations of a response as small expressions that know their inverse and its curvature."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import box_cox, inv_box_cox

Fn = Callable[[Column], Column]


@dataclass(frozen=True)
class Step:
    """One function with its inverse; first and second: derivatives of the inverse, None if not known."""

    name: str
    forward: Fn
    inverse: Fn
    first: Fn | None = None
    second: Fn | None = None


@dataclass(frozen=True)
class Transformation:
    """A chain of steps, innermost first. Build it by methods: ``Transformation().log()`` or ``(Transformation() + 1).sqrt()``."""

    steps: tuple[Step, ...] = ()

    def then(self, *steps: Step) -> Transformation:
        return Transformation((*self.steps, *steps))

    @property
    def identity(self) -> bool:
        return not self.steps

    def __call__(self, x: Column) -> Column:
        for s in self.steps:
            x = s.forward(x)
        return x

    def inverse(self, x: Column) -> Column:
        for s in reversed(self.steps):
            x = s.inverse(x)
        return x

    def inverted(self) -> Transformation:
        return Transformation(tuple(Step(f"inverse of {s.name}", s.inverse, s.forward) for s in reversed(self.steps)))

    def mean(self, mu: Column, sigma: Column) -> Column:
        """Mean on the response scale: inv(mu) + sigma^2 / 2 * inv''(mu); unadjusted where that is missing."""
        plain = self.inverse(mu)
        if self.identity:
            return mu
        return F.coalesce(plain + sigma * sigma / 2 * self._curvature(mu), plain)

    def _curvature(self, x: Column) -> Column:
        """Second derivative of the inverse: by the chain rule, or by central differences if a step lacks its own."""
        if any(s.first is None or s.second is None for s in self.steps):
            h = F.greatest(F.abs(x), F.lit(1.0)) * 1e-4
            return (self.inverse(x + h) - 2 * self.inverse(x) + self.inverse(x - h)) / (h * h)
        value, d1, d2 = x, F.lit(1.0), F.lit(0.0)
        for s in reversed(self.steps):
            f1, f2 = s.first(value), s.second(value)
            value, d1, d2 = s.inverse(value), f1 * d1, f2 * d1 * d1 + f1 * d2
        return d2

    def log(self, base: float = math.e, shift: float = 0.0) -> Transformation:
        k = math.log(base)
        back = lambda r: F.exp(r * k)
        out = self if not shift else self + shift
        return out.then(Step(f"log{base:g}", lambda x: F.ln(x) / k, back, lambda r: k * back(r), lambda r: k * k * back(r)))

    def log10(self) -> Transformation:
        return self.log(10)

    def log2(self) -> Transformation:
        return self.log(2)

    def log1p(self) -> Transformation:
        return self.then(Step("log1p", F.log1p, F.expm1, F.exp, F.exp))

    def expm1(self) -> Transformation:
        return self.then(Step("expm1", F.expm1, F.log1p, lambda r: 1 / (1 + r), lambda r: -1 / ((1 + r) * (1 + r))))

    def exp(self) -> Transformation:
        return self.then(Step("exp", F.exp, F.ln, lambda r: 1 / r, lambda r: -1 / (r * r)))

    def sqrt(self) -> Transformation:
        return self.then(Step("sqrt", F.sqrt, lambda r: r * r, lambda r: 2 * r, lambda r: F.lit(2.0)))

    def box_cox(self, lam: float | Column) -> Transformation:
        return self.then(Step("box_cox", lambda x: box_cox(x, lam), lambda r: inv_box_cox(r, lam)))

    def inv_box_cox(self, lam: float | Column) -> Transformation:
        return self.then(Step("inv_box_cox", lambda x: inv_box_cox(x, lam), lambda r: box_cox(r, lam)))

    def __pow__(self, p: float) -> Transformation:
        if p == 0:
            raise ValueError("a power of zero has no inverse")
        q = 1 / p
        return self.then(Step(f"^{p:g}", lambda x: F.pow(x, F.lit(float(p))), lambda r: F.pow(r, F.lit(q)), lambda r: q * F.pow(r, F.lit(q - 1)), lambda r: q * (q - 1) * F.pow(r, F.lit(q - 2))))

    def __rpow__(self, b: float) -> Transformation:
        k = math.log(b)
        return self.then(Step(f"{b:g}^", lambda x: F.pow(F.lit(float(b)), x), lambda r: F.ln(r) / k, lambda r: 1 / (r * k), lambda r: -1 / (r * r * k)))

    def _linear(self, name: str, forward: Fn, inverse: Fn, slope: float) -> Transformation:
        return self.then(Step(name, forward, inverse, lambda r: F.lit(slope), lambda r: F.lit(0.0)))

    def __add__(self, b: float) -> Transformation:
        return self._linear(f"+{b:g}", lambda x: x + b, lambda r: r - b, 1.0)

    __radd__ = __add__

    def __sub__(self, b: float) -> Transformation:
        return self + -b

    def __rsub__(self, b: float) -> Transformation:
        return self._linear(f"{b:g}-", lambda x: b - x, lambda r: b - r, -1.0)

    def __neg__(self) -> Transformation:
        return 0 - self

    def __pos__(self) -> Transformation:
        return self

    def __mul__(self, b: float) -> Transformation:
        return self._linear(f"*{b:g}", lambda x: x * b, lambda r: r / b, 1 / b)

    __rmul__ = __mul__

    def __truediv__(self, b: float) -> Transformation:
        return self * (1 / b)

    def __rtruediv__(self, a: float) -> Transformation:
        return self.then(Step(f"{a:g}/", lambda x: a / x, lambda r: a / r, lambda r: -a / (r * r), lambda r: 2 * a / (r * r * r)))

    def __repr__(self) -> str:
        return " | ".join(["y", *(s.name for s in self.steps)])


IDENTITY = Transformation()


def new_transformation(forward: Fn, inverse: Fn, name: str = "custom") -> Transformation:
    """A transformation from any pair of column functions."""
    return Transformation((Step(name, forward, inverse),))


def bias_adjust(transformation: Transformation, mu: Column, sigma: Column) -> Column:
    return transformation.mean(mu, sigma)
