"""Accuracy of fitted models on their training data and of forecasts on test data."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.calendar import seasonal_lag
from seriesloom.functions.measures import Inputs, Measure, point_accuracy_measures
from seriesloom.functions.stats import clean
from seriesloom.meta import ForecastTable, ModelTable, SeriesFrame, join_on, quoted
from seriesloom.plans.lifecycle import augment
from seriesloom.sources.saved import saved


def _flat(measures: Any) -> dict[str, Measure]:
    """Named measures; nested mappings and sequences are flattened."""
    if isinstance(measures, SeriesFrame):
        raise ValueError("measures are expected here; pass data by name")
    if isinstance(measures, Mapping):
        out: dict[str, Measure] = {}
        for k, v in measures.items():
            out |= {k: v} if callable(v) else _flat(v)
        return out
    return reduce(lambda a, b: a | _flat(b), measures, {})


def _asked(measures: Mapping[str, Measure]) -> set[tuple[bool, int | None, int | None]]:
    """The options of the scales that the measures divide by, beside the default ones: each is tried on columns that stand for none."""
    found: set[tuple[bool, int | None, int | None]] = set()
    none = F.lit(None).cast("double")
    for f in measures.values():
        f(Inputs(none, none, none, none, none, none, none, None, none, none, lambda x: x, None, found))
    return found


def _scales(train: DataFrame, by: Sequence[str], y: str, index: str, m: int, asked: set[tuple[bool, int | None, int | None]]) -> DataFrame:
    """(by, abs_scale, sq_scale, ...): mean absolute and squared difference of each training series, seasonal if m > 1 or as asked."""
    w, rows, aggs = Window.partitionBy(*quoted(by)), train, []
    for k, (demean, d, D) in enumerate([(False, None, None), *sorted(asked, key=repr)]):
        x = f"__d{k}"
        rows = rows.withColumn(x, clean(F.col(y)))
        for lag, times in ((m, int(m > 1) if D is None else D), (1, int(m == 1) if d is None else d)):
            for _ in range(times):
                rows = rows.withColumn(x, F.col(x) - F.lag(x, lag).over(w.orderBy(F.col(f"`{index}`"))))
        if demean:
            rows = rows.withColumn(x, F.col(x) - F.avg(x).over(w))
        end = "" if not k else f"_{int(demean)}_{d}_{D}"
        aggs += [F.avg(F.abs(x)).alias(f"abs_scale{end}"), F.avg(F.col(x) * F.col(x)).alias(f"sq_scale{end}")]
    return rows.groupBy(*quoted(by)).agg(*aggs)


def _score(rows: DataFrame, by: Sequence[str], index: str, measures: Mapping[str, Measure], back: Callable[[Column], Column], kind: str, python: Mapping[str, Any] | None = None, order: Sequence[str] = (), moved: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*quoted(by)).orderBy(*quoted([*order, index]))
    rows = rows.withColumns({"__dy": F.col("__y") - F.lag("__y").over(w), "__eb": F.lag("__e").over(w)})
    sample = F.col("sample") if "sample" in rows.columns else None
    i = Inputs(F.col("__e"), F.col("__y"), F.col("__fc"), F.col("__dy"), F.col("__eb"), F.col("mu"), F.col("sigma"), sample, F.col("abs_scale"), F.col("sq_scale"), back, F.col("model").isin(*moved) if moved else None)
    out = rows.groupBy(*quoted(by)).agg(F.lit(kind).alias("type"), *[f(i).alias(k) for k, f in measures.items()])
    for name, f in (python or {}).items():
        out = join_on(out, _python_measure(rows, by, index, name, f), by)
    return out


def _python_measure(rows: DataFrame, by: Sequence[str], index: str, name: str, f: Any) -> DataFrame:
    """A Python function of (resid, actual) arrays; null for a group where it fails."""
    by = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        try:
            value = float(f(pdf["__e"].to_numpy(float), pdf["__y"].to_numpy(float)))
        except Exception:  # a measure that fails is missing
            value = None
        return pd.DataFrame([[*pdf[by].iloc[0], value]], columns=[*by, name])

    schema = T.StructType([*[rows.schema[k] for k in by], T.StructField(name, T.DoubleType())])
    return rows.select(*quoted([*by, index]), "__e", "__y").groupBy(*quoted(by)).applyInPandas(run, schema)


def accuracy_training(table: ModelTable, measures: Any = point_accuracy_measures, period: float | None = None, python: Mapping[str, Any] | None = None) -> DataFrame:
    """One row for each series and model: errors of fitted values on the response scale."""
    a = augment(table)
    m = seasonal_lag(period, table.interval)
    y = F.col(f"`{table.response}`")
    scale = _scales(table.data.df.withColumn("__y", y.cast("double")), table.key, "__y", table.index, m, _asked(_flat(measures)))
    rows = a.df.withColumns({"__e": clean(F.col("resid")), "__y": clean(y), "__fc": F.col("fitted"), "mu": F.col("fitted"), "sigma": F.lit(0.0)})
    rows = join_on(rows, scale, table.key, "left")
    return _score(rows, [*table.key, "model"], table.index, _flat(measures), lambda x: x, "Training", python)


def accuracy(fc: ForecastTable, data: SeriesFrame, measures: Any = point_accuracy_measures, by: Sequence[str] | None = None, period: float | None = None, python: Mapping[str, Any] | None = None, warn: bool = False) -> DataFrame:
    """One row for each group of ``by`` (default: model and the data's keys): errors of the forecasts' means.

    Forecasts without an actual stay null; with ``warn`` their number and range
    are reported.  The training series of a group are the rows before its
    earliest forecast; of several series or folds in a group, those of the
    latest start count.
    """
    by = list(by) if by is not None else ["model", *[k for k in fc.key if k in data.key]]
    if "model" not in by and "model" in fc.key:
        warnings.warn("forecasts of several models are scored together", stacklevel=2)
    key, index, response = list(data.key), data.index, fc.response
    m = seasonal_lag(period, fc.interval)
    fc = saved(fc, "forecasts")  # read for the scores, for their beginnings and, with ``warn``, for what has no actual
    actual = data.df.select(*quoted(key), F.col(f"`{index}`"), clean(F.col(f"`{response}`").cast("double")).alias("__y"))
    if warn and (gone := missing_future(fc, data).first()) and gone.n:
        warnings.warn(f"The future dataset is incomplete: {gone.n} observations are missing between {gone.first} and {gone.last}", stacklevel=2)
    rows = join_on(fc.df, actual, [*key, index], "left").withColumn("__fc", F.col("mean")).withColumn("__e", F.col("__y") - F.col("mean"))
    firsts = fc.df.groupBy(*quoted(dict.fromkeys([*by, *key]))).agg(F.min(index).alias("__from"))
    latest = firsts.withColumn("__k", F.row_number().over(Window.partitionBy(*quoted(by)).orderBy(F.col("__from").desc(), *quoted(key)))).filter("__k = 1").drop("__k")
    named = latest.withColumnsRenamed({k: f"__g_{k}" for k in key})
    on = F.col(f"`{index}`") < F.col("__from")
    for k in key:
        on &= F.col(f"`{k}`").eqNullSafe(F.col(f"`__g_{k}`"))
    train = actual.join(named, on)
    group = [f"__g_{c}" if c in key else c for c in by]
    scale = _scales(train, group, "__y", index, m, _asked(_flat(measures))).withColumnsRenamed({f"__g_{c}": c for c in key})
    rows = join_on(rows, scale, by, "left")
    return _score(rows, by, index, _flat(measures), fc.back, "Test", python, [c for c in fc.key if c not in by], [k for k in fc.inverse if "model" in fc.key])


def missing_future(fc: ForecastTable, data: SeriesFrame) -> DataFrame:
    """(n, first, last) of forecasts that have no row in the data."""
    cols = [*data.key, data.index]
    return join_on(fc.df, data.df, cols, "left_anti").agg(F.count("*").alias("n"), F.min(data.index).alias("first"), F.max(data.index).alias("last"))


def benchmark(fc: ForecastTable, data: SeriesFrame, period: float | None = None) -> ForecastTable:
    """The seasonal naive forecast of each (model, series): last season of training values, residual mean square by step."""
    m = seasonal_lag(period, fc.interval)
    key, index = list(data.key), data.index
    start = fc.df.groupBy("model", *quoted(key)).agg(F.min(index).alias("__from"))
    actual = data.df.select(*quoted(key), F.col(f"`{index}`"), clean(F.col(f"`{fc.response}`").cast("double")).alias("__y"))
    train = join_on(actual, start, key).filter(F.col(f"`{index}`") < F.col("__from"))
    w = Window.partitionBy("model", *quoted(key))
    asc, desc = w.orderBy(F.col(f"`{index}`")), w.orderBy(F.col(f"`{index}`").desc())
    rows = train.withColumns({"__d": F.col("__y") - F.lag("__y", m).over(asc), "__r": F.row_number().over(desc)})
    last = F.array_sort(F.collect_list(F.when(F.col("__r") <= m, F.struct((-F.col("__r")).alias("r"), F.col("__y").alias("y")))))
    got = rows.groupBy("model", *quoted(key)).agg(last.alias("__tail"), F.avg(F.col("__d") * F.col("__d")).alias("__mse"))
    h = F.row_number().over(asc)
    out = fc.df.select("model", *quoted(key), F.col(f"`{index}`")).withColumn("__h", h)
    out = join_on(out, got, ["model", *key])
    out = out.withColumns({"mu": F.get("__tail", ((F.col("__h") - 1) % m).cast("int"))["y"], "sigma": F.sqrt(F.col("__mse") * F.ceil(F.col("__h") / m))})
    return ForecastTable(out.withColumn("mean", F.col("mu")).drop("__h", "__tail", "__mse"), ("model", *data.key), index, fc.interval, fc.response)


def skill_score(fc: ForecastTable, data: SeriesFrame, measures: Any, by: Sequence[str] | None = None, period: float | None = None) -> DataFrame:
    """1 - measure / measure of the seasonal naive benchmark, for each measure."""
    flat = _flat(measures)
    by = list(by) if by is not None else ["model", *data.key]
    mine = accuracy(fc, data, flat, by, period)
    base = accuracy(benchmark(fc, data, period), data, flat, by, period).select(*quoted(by), *[F.col(k).alias(f"__b_{k}") for k in flat])
    return join_on(mine, base, by).select(*quoted(by), "type", *[(1 - F.when(F.col(f"__b_{k}") != 0, F.col(k) / F.col(f"__b_{k}"))).alias(k) for k in flat])
