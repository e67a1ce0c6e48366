"""Weighted sums of models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.stats import divide
from seriesloom.meta import ForecastTable, ModelTable, SeriesFrame, join_on, quoted
from seriesloom.sources.saved import saved


@dataclass(frozen=True)
class Combination:
    """sum of weight * model. ``rule`` inv_var: weights are the inverse residual variances of each series."""

    defs: tuple[Any, ...]
    weights: tuple[float, ...]
    rule: str = "fixed"
    parts: tuple[str, ...] = ()
    hide: bool = True

    @classmethod
    def of(cls, d: Any) -> Combination:
        return d if isinstance(d, Combination) else cls((d,), (1.0,))

    @property
    def hidden(self) -> tuple[str, ...]:
        return self.parts if self.hide else ()

    def placed(self, names: Sequence[str]) -> Combination:
        return replace(self, parts=tuple(names))

    def __add__(self, other: Any) -> Combination:
        if other == 0:
            return self
        o = Combination.of(other)
        return Combination(self.defs + o.defs, self.weights + o.weights)

    __radd__ = __add__

    def __sub__(self, other: Any) -> Combination:
        return self + -1 * Combination.of(other)

    def __neg__(self) -> Combination:
        return self * -1

    def __mul__(self, w: float) -> Combination:
        if not isinstance(w, int | float):
            raise TypeError("models can't be multiplied with each other")
        return replace(self, weights=tuple(x * w for x in self.weights))

    __rmul__ = __mul__

    def __truediv__(self, w: float) -> Combination:
        if not isinstance(w, int | float):
            raise TypeError("models can't be divided by each other")
        return self * (1 / w)

    def weighted(self, rows: DataFrame, by: Sequence[str], variance: DataFrame | None) -> DataFrame:
        """Add __w; inverse variances are normalised within each series."""
        names = F.array(*[F.lit(p) for p in self.parts])
        given = F.element_at(F.map_from_arrays(names, F.array(*[F.lit(float(w)) for w in self.weights])), F.col("model"))
        if self.rule == "fixed":
            return rows.withColumn("__w", given)
        w = Window.partitionBy(*quoted(by))
        inv = variance.withColumn("__i", divide(F.lit(1.0), F.col("__v")))
        inv = inv.withColumn("__w", F.col("__i") / F.sum("__i").over(w)).select(*quoted([*by, "model"]), "__w")
        return join_on(rows, inv, [*by, "model"])

    def apply(self, name: str, table: ModelTable, fc: ForecastTable) -> ForecastTable:
        """Mean: sum of w mu; variance: the quadratic form of w sigma with the residuals' correlation over complete rows.

        Both stay normal on the response scale; components with a transformation
        enter by their mean and have no variance here.
        """
        key = list(table.key)
        res = saved(self._residuals(table), "residuals")
        var = res.groupBy(*quoted(key), "model").agg(F.var_samp("resid").alias("__v"))
        rows = fc.df.filter(F.col("model").isin(*self.parts))
        rows = self.weighted(rows, key, var)
        at = [c for c in fc.key if c != "model"] + [fc.index] + (["h"] if "h" in fc.df.columns else [])
        complete = F.count("resid").over(Window.partitionBy(*quoted([*key, table.index]))) == len(self.parts)
        full = res.withColumn("__c", complete).filter("__c")
        pair = full.select(*quoted([*key, table.index]), F.col("model").alias("__a"), F.col("resid").alias("__ra"))
        other = full.select(*quoted([*key, table.index]), F.col("model").alias("__b"), F.col("resid").alias("__rb"))
        corr = join_on(pair, other, [*key, table.index]).groupBy(*quoted(key), "__a", "__b").agg(F.corr("__ra", "__rb").alias("__rho"))
        a = rows.select(*quoted(at), F.col("model").alias("__a"), (F.col("__w") * F.col("sigma")).alias("__sa"))
        b = rows.select(*quoted(at), F.col("model").alias("__b"), (F.col("__w") * F.col("sigma")).alias("__sb"))
        rho = F.when(F.col("__a") == F.col("__b"), 1.0).otherwise(F.coalesce(F.when(~F.isnan("__rho"), F.col("__rho")), F.lit(0.0)))
        quad = join_on(join_on(a, b, at), corr, [*key, "__a", "__b"], "left").groupBy(*quoted(at)).agg(F.sum(F.col("__sa") * F.col("__sb") * rho).alias("__var"))
        total = rows.groupBy(*quoted(at)).agg(F.sum(F.col("__w") * F.col("mean")).alias("mu"), F.max(F.col("model").isin(*fc.inverse)).alias("__t"), F.count("mean").alias("__n"))
        mu = F.when(F.col("__n") == len(self.parts), F.col("mu"))
        got = join_on(total.withColumn("mu", mu), quad, at).withColumn("sigma", F.when(~F.col("__t"), F.sqrt(F.greatest("__var", F.lit(0.0)))))
        got = got.select(*quoted(at), F.lit(name).alias("model"), "mu", "sigma", F.col("mu").alias("mean"))
        return replace(fc, df=fc.df.unionByName(got, allowMissingColumns=True))

    def _residuals(self, table: ModelTable) -> DataFrame:
        from .lifecycle import augment

        return augment(replace(table, plans={})).df.filter(F.col("model").isin(*self.parts))

    def augmented(self, name: str, table: ModelTable, rows: SeriesFrame) -> SeriesFrame:
        key = list(table.key)
        mine = rows.df.filter(F.col("model").isin(*self.parts))
        var = mine.groupBy(*quoted(key), "model").agg(F.var_samp("resid").alias("__v"))
        w = self.weighted(mine, key, var)
        got = w.groupBy(*quoted([*key, table.index])).agg(F.max(table.response).alias(table.response), F.sum(F.col("__w") * F.col("fitted")).alias("f"), F.count("fitted").alias("__n"))
        f = F.when(F.col("__n") == len(self.parts), F.col("f"))
        got = got.withColumn("fitted", f).withColumn("resid", F.col(table.response) - F.col("fitted"))
        got = got.select(*quoted(key), F.lit(name).alias("model"), F.col(f"`{table.index}`"), table.response, "fitted", "resid", F.col("resid").alias("innov"))
        return replace(rows, df=rows.df.unionByName(got))


    def paths(self, name: str, table: ModelTable, rows: DataFrame, key: Sequence[str]) -> DataFrame:
        """Simulated paths: of each repetition the weighted sum of the parts' paths."""
        var = self._residuals(table).groupBy(*quoted(table.key), "model").agg(F.var_samp("resid").alias("__v")) if self.rule != "fixed" else None
        mine = self.weighted(rows.filter(F.col("model").isin(*self.parts)), list(table.key), var)
        at = [*key, "rep", table.index, "h"]
        got = mine.groupBy(*quoted(at)).agg(F.sum(F.col("__w") * F.col("sim")).alias("sim"), F.count("sim").alias("__n"))
        sim = F.when(F.col("__n") == len(self.parts), F.col("sim"))
        return got.select(*quoted(key), F.lit(name).alias("model"), "rep", F.col(f"`{table.index}`"), "h", sim.alias("sim"), sim.alias("sim_link"))


def combination_ensemble(*defs: Any, weights: str = "equal") -> Combination:
    if weights not in ("equal", "inv_var"):
        raise ValueError("weights are equal or inv_var")
    return Combination(defs, (1 / len(defs),) * len(defs), "fixed" if weights == "equal" else "inv_var")


def combination_weighted(*defs: Any, weights: Sequence[float]) -> Combination:
    """Weights are divided by their sum."""
    if len(weights) != len(defs):
        raise ValueError("a weight for each model is needed")
    return Combination(defs, tuple(w / sum(weights) for w in weights))


def combination_model(*defs: Any, combine: Any = combination_ensemble, **args: Any) -> Combination:
    if not defs:
        raise ValueError("a combination needs a model")
    if len({d.response for d in defs}) != 1:
        raise ValueError("a combination needs one response")
    return combine(*defs, **args)

