"""Regressors: trend with knots, seasonal dummies, Fourier terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def trend(t: Column, knots: tuple[float, ...] = ()) -> dict[str, Column]:
    """``t`` counts from 1; after each knot a further slope."""
    out = {"trend": t.cast("double")}
    for k in knots:
        out[f"trend_{k:g}"] = F.greatest(t.cast("double") - k, F.lit(0.0))
    return out


def season(step: Column, period: float) -> dict[str, Column]:
    """Dummies of the seasons 2, 3, ...; ``step`` counts from the epoch."""
    at = F.floor(F.pmod(step.cast("double"), F.lit(float(period))) + 1)
    return {f"season_{k}": F.when(at == k, 1.0).otherwise(0.0) for k in range(2, int(math.ceil(period)) + 1)}


def fourier(t: Column, period: float, K: int) -> dict[str, Column]:
    """Cosines and sines of the first K harmonics; a sine that is always zero is left out."""
    if 2 * K > period:
        raise ValueError("K must be at most half the period")
    out = {}
    for k in range(1, K + 1):
        angle = F.pmod(2 * k * t.cast("double") / period, F.lit(2.0)) * math.pi
        out[f"C{k}_{period:g}"] = F.cos(angle)
        if not (2 * k / period).is_integer():
            out[f"S{k}_{period:g}"] = F.sin(angle)
    return out
