"""Features of series: aggregates in Spark, any Python function by group."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.calendar import get_frequencies
from seriesloom.functions.stats import clean, divide
from seriesloom.meta import SeriesFrame, join_on, quoted

#: A feature in Spark: from the value and its predecessor's column to named aggregates.
Feature = Callable[[Column, Column], dict[str, Column]]
_registry: list[tuple[Any, str, str, frozenset[str]]] = []


def register_feature(fn: Any, tags: Sequence[str], package: str = "seriesloom", name: str | None = None) -> Any:
    _registry.append((fn, name or getattr(fn, "__name__", "feature"), package, frozenset(tags)))
    return fn


def feature_set(packages: Sequence[str] | None = None, tags: Sequence[str] | None = None) -> list[Any]:
    """Registered features of any of the packages with any of the tags."""
    return [f for f, _, p, t in _registry if (packages is None or p in packages) and (tags is None or t & set(tags))]


def feature_table() -> list[dict[str, Any]]:
    return [{"feature": n, "package": p, "tags": sorted(t)} for _, n, p, t in _registry]


def basic(y: Column, before: Column) -> dict[str, Column]:
    return {"n": F.count(y), "mean": F.avg(y), "sd": F.stddev_samp(y), "min": F.min(y), "max": F.max(y)}


def quantiles(y: Column, before: Column) -> dict[str, Column]:
    return {f"q{int(p * 100)}": F.percentile(y, p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)}


def differences(y: Column, before: Column) -> dict[str, Column]:
    d = y - before
    return {"diff_mean": F.avg(d), "diff_sd": F.stddev_samp(d), "crossings": F.sum((F.signum(d) != 0).cast("int"))}


def acf1(y: Column, before: Column) -> dict[str, Column]:
    """Lag-one autocorrelation from plain sums."""
    return {"acf1": lag_one(y, before)}


def lag_one(y: Column, before: Column) -> Column:
    """Sum over t of (y_t - m)(y_(t-1) - m) over the sum of (y_t - m)^2, m the mean; null for a single value."""
    m, both = F.avg(y), y.isNotNull() & before.isNotNull()
    over = F.sum(F.when(both, y * before)) - m * (F.sum(F.when(both, y)) + F.sum(F.when(both, before))) + F.sum(both.cast("int")) * m * m
    return F.when(F.count(y) > 1, divide(over, F.sum(y * y) - F.count(y) * m * m))


def shape(y: Column, before: Column) -> dict[str, Column]:
    return {"skewness": F.skewness(y), "kurtosis": F.kurtosis(y)}


for _f, _t in ((basic, ["summary"]), (quantiles, ["summary", "distribution"]), (differences, ["change"]), (acf1, ["autocorrelation"]), (shape, ["distribution"])):
    register_feature(_f, _t)


def features(frame: SeriesFrame, var: str | Column | None = None, features: Sequence[Any] | Mapping[str, Any] = (basic,), prefix: str = "") -> DataFrame:
    """One row for each series with all features of ``var`` (default: the first measured variable).

    Functions of (value, previous value) columns are fused into one aggregation;
    functions that take a numpy array run by group in Python, get ``period`` and
    ``index`` if they ask for them, and give a number, a dict or a sequence.  A
    feature that fails for a series is null.  A mapping names the features: its
    columns are ``name_part``; unnamed parts are numbered.
    """
    named = list(features.items()) if isinstance(features, Mapping) else [("", f) for f in features]
    y = var if isinstance(var, Column) else F.col(f"`{var or frame.measured[0]}`")
    native = [(n, f) for n, f in named if not _is_python(f)]
    python = [(n, f) for n, f in named if _is_python(f)]
    df = frame.df.withColumn("__y", clean(y.cast("double")))
    df = df.withColumn("__before", F.lag("__y").over(frame.window()))
    out = None
    if native:
        cols = {f"{prefix}{n + '_' if n else ''}{k}": c for n, f in native for k, c in f(F.col("__y"), F.col("__before")).items()}
        out = df.groupBy(*quoted(frame.key)).agg(*[c.alias(k) for k, c in cols.items()])
    for n, f in python:
        one = _python_feature(frame, df, n, f, prefix)
        out = one if out is None else join_on(out, one, frame.key)
    return out


def _is_python(f: Any) -> bool:
    return getattr(f, "feature_names", None) is not None


def python_feature(names: Sequence[str]) -> Callable[[Any], Any]:
    """Mark a function of a numpy array as a feature with these outputs."""

    def mark(f: Any) -> Any:
        f.feature_names = tuple(x or f"...{k + 1}" for k, x in enumerate(names))
        return f

    return mark


def _python_feature(frame: SeriesFrame, df: DataFrame, name: str, f: Any, prefix: str) -> DataFrame:
    asks, period, key, index = inspect.signature(f).parameters, get_frequencies(None, frame.interval)[0], list(frame.key), frame.index
    cols = [f"{prefix}{name + '_' if name else ''}{k}" for k in f.feature_names]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        more = ({"period": period} if "period" in asks else {}) | ({"index": pdf[index].to_numpy()} if "index" in asks else {})
        try:
            got = f(pdf["__y"].to_numpy(float), **more)
            values = list(got.values()) if isinstance(got, dict) else list(np.atleast_1d(got))
        except Exception:  # a feature that fails is missing
            values = [None] * len(cols)
        return pd.DataFrame([[*pdf[key].iloc[0], *values]], columns=[*key, *cols])

    schema = T.StructType([*[df.schema[k] for k in key], *[T.StructField(c, T.DoubleType()) for c in cols]])
    return df.select(*quoted([*key, index]), "__y").groupBy(*quoted(key)).applyInPandas(run, schema)


def features_at(frame: SeriesFrame, variables: Sequence[str], features_: Sequence[Any] | Mapping[str, Any] = (basic,)) -> DataFrame:
    """Features of several variables in one aggregation; columns are ``variable_feature``."""
    named = list(features_.items()) if isinstance(features_, Mapping) else [("", f) for f in features_]
    df = frame.df
    for k, v in enumerate(variables):
        df = df.withColumn(f"__y{k}", clean(F.col(f"`{v}`").cast("double")))
    df = df.withColumns({f"__b{k}": F.lag(f"__y{k}").over(frame.window()) for k in range(len(variables))})
    cols = {f"{v}_{n + '_' if n else ''}{part}": c for k, v in enumerate(variables) for n, f in named for part, c in f(F.col(f"__y{k}"), F.col(f"__b{k}")).items()}
    return df.groupBy(*quoted(frame.key)).agg(*[c.alias(k) for k, c in cols.items()])


def features_if(frame: SeriesFrame, predicate: Callable[[T.StructField], bool], features_: Sequence[Any] | Mapping[str, Any] = (basic,)) -> DataFrame:
    return features_at(frame, [c for c in frame.measured if predicate(frame.df.schema[c])], features_)


def features_all(frame: SeriesFrame, features_: Sequence[Any] | Mapping[str, Any] = (basic,)) -> DataFrame:
    return features_if(frame, lambda f: isinstance(f.dataType, T.NumericType), features_)
