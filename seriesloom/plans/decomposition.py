"""Additive decomposition, and models of its components."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions.calendar import seasonal_lag
from seriesloom.functions.stats import clean
from seriesloom.meta import DecompTable, ForecastTable, ModelTable, SeriesFrame, join_on, quoted

from .lifecycle import forecast, model
from .models import NAIVE, SNAIVE


def decompose(frame: SeriesFrame, response: str, period: float | None = None) -> DecompTable:
    """Trend (centred moving average, null at the ends), season (means of what is left by season, centred), remainder.

    ``season_adjust`` is the response without the season and has no gaps.
    """
    m = seasonal_lag(period, frame.interval)
    w, half = frame.window(), m // 2
    y = clean(F.col(f"`{response}`").cast("double"))
    df = frame.df.withColumn("__t", F.row_number().over(w)).withColumn("__y", y)
    mean = F.avg("__y").over(w.rowsBetween(-half, half if m % 2 else half - 1))
    if m % 2 == 0:
        mean = (mean + F.avg("__y").over(w.rowsBetween(-half + 1, half))) / 2
    size = F.count("*").over(Window.partitionBy(*quoted(frame.key)))
    inside = (F.col("__t") > half) & (F.col("__t") <= F.col("__n") - half)
    df = df.withColumn("__n", size).withColumn("trend", mean)
    df = df.withColumn("trend", F.when(inside, F.col("trend"))).withColumn("__s", (F.col("__t") - 1) % m)
    per = df.groupBy(*quoted(frame.key), "__s").agg(F.avg(F.col("__y") - F.col("trend")).alias("__m"))
    per = per.withColumn("season", F.col("__m") - F.avg("__m").over(Window.partitionBy(*quoted(frame.key)))).drop("__m")
    out = join_on(df, per, [*frame.key, "__s"])
    out = out.select(*quoted([*frame.key, frame.index]), F.col("__y").alias(response), "trend", "season", (F.col("__y") - F.col("season")).alias("season_adjust"), (F.col("__y") - F.col("trend") - F.col("season")).alias("remainder"))
    return DecompTable(out, frame.key, frame.index, frame.interval, response, "classical", {"season": float(m)}, {response: "trend + season + remainder", "season_adjust": "trend + remainder"})


@dataclass(frozen=True)
class DecompositionModel:
    """Models for the parts of a decomposition; a seasonal part without a model gets the seasonal naive one."""

    response: str
    models: Mapping[str, Any]
    period: float | None = None
    parts: tuple[str, ...] = ("season_adjust", "season")

    def fit(self, frame: SeriesFrame) -> FittedDecomposition:
        d = decompose(frame, self.response, self.period)
        tables = {}
        for part in self.parts:
            own = self.models.get(part) or (SNAIVE(part, d.seasons["season"]) if part == "season" else NAIVE(part))
            series = SeriesFrame(d.df.select(*quoted([*d.key, d.index]), part), d.key, d.index, d.interval)
            tables[part] = model(series, **{part: own})
        return FittedDecomposition(self, d, tables)


@dataclass(frozen=True)
class FittedDecomposition:
    definition: DecompositionModel
    components: DecompTable
    tables: Mapping[str, ModelTable]

    def check(self) -> SeriesFrame:
        """Rows where the parts do not add up to the response."""
        d = self.components
        total = reduce(lambda a, b: a + b, [F.col(p) for p in self.definition.parts])
        return SeriesFrame(d.df.filter(F.abs(total - F.col(d.response)) > 1e-6), d.key, d.index, d.interval)

    def forecast(self, h: int | str | None = None, name: str = "decomposition") -> ForecastTable:
        """Sum of the parts' forecasts, taken as independent."""
        fcs = [forecast(t, h) for t in self.tables.values()]
        d = self.components
        rows = reduce(lambda a, b: a.unionByName(b), [f.df for f in fcs])
        out = rows.groupBy(*quoted([*d.key, d.index]), "h").agg(F.lit(name).alias("model"), F.sum("mu").alias("mu"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("sigma"))
        return ForecastTable(out.withColumn("mean", F.col("mu")), (*d.key, "model"), d.index, d.interval, d.response)


def decomposition_model(response: str, period: float | None = None, **models: Any) -> DecompositionModel:
    return DecompositionModel(response, models, period)


def season_adjusted(d: DecompTable) -> SeriesFrame:
    return replace(d, df=d.df.select(*quoted([*d.key, d.index]), d.alias("season_adjust").alias("season_adjust")))
