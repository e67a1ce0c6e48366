"""Distribution columns of forecasts: quantiles, intervals, point forecasts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.stats import box_cox, sample_quantile, z_of
from seriesloom.meta import ForecastTable, Interval, SeriesFrame


def quantile(fc: ForecastTable, p: float) -> Column:
    """Exact under a transformation: the inverse of the normal quantile; of a sample the interpolated one."""
    normal = fc.back(F.col("mu") + z_of(p) * F.col("sigma"))
    if "sample" not in fc.df.columns:
        return normal
    return F.when(F.col("sample").isNotNull(), sample_quantile(F.col("sample"), p)).otherwise(normal)


def hilo(fc: ForecastTable, levels: Sequence[float] = (80, 95)) -> SeriesFrame:
    """Add for each level a column ``95%`` of (lower, upper, level)."""
    cols = {}
    for level in levels:
        low, high = quantile(fc, 0.5 - level / 200), quantile(fc, 0.5 + level / 200)
        cols[f"{level:g}%"] = F.struct(F.least(low, high).alias("lower"), F.greatest(low, high).alias("upper"), F.lit(float(level)).alias("level"))
    return SeriesFrame(fc.df.withColumns(cols), fc.key, fc.index, fc.interval)


def unpack_hilo(df: DataFrame, cols: Sequence[str], sep: str = "_") -> DataFrame:
    """Intervals as ``<col>_lower`` and ``<col>_upper``."""
    for c in cols:
        if df.schema[c].dataType.typeName() != "struct":
            raise ValueError(f"{c} holds no intervals")
        df = df.withColumn(f"{c}{sep}lower", F.col(f"`{c}`.lower")).withColumn(f"{c}{sep}upper", F.col(f"`{c}`.upper")).drop(c)
    return df


def point_forecasts(fc: ForecastTable, measures: Mapping[str, Callable[[Column, Column], Column]]) -> ForecastTable:
    """Further columns from (mean, median)."""
    return fc.with_columns({k: f(F.col("mean"), quantile(fc, 0.5)) for k, f in measures.items()})


def as_forecasts(df: DataFrame, key: Sequence[str], index: str, response: str, mu: str = "mu", sigma: str = "sigma", interval: Interval = Interval()) -> ForecastTable:
    """A forecast table from columns; the key must have ``model`` for models to be told apart."""
    out = df.withColumnsRenamed({mu: "mu", sigma: "sigma"})
    if "mean" not in out.columns:
        out = out.withColumn("mean", F.col("mu"))
    return ForecastTable(out, tuple(key), index, interval, response)


def from_interval(df: DataFrame, lower: str, upper: str, level: float, lam: float | None = None) -> DataFrame:
    """mu, sigma of the normal distribution whose central interval is given; without one sigma is 0.

    With ``lam`` the distribution is normal after the Box-Cox transformation, and mu and sigma are on that scale.
    """
    low, high = (F.col(f"`{c}`") if lam is None else box_cox(F.col(f"`{c}`"), lam) for c in (lower, upper))
    half = (high - low) / 2
    return df.withColumns({"mu": low + half, "sigma": F.coalesce(half / z_of((1 + level / 100) / 2), F.lit(0.0))})
