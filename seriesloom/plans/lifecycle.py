"""Fitting, forecasting and what else is asked of fitted models."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.calendar import seasonal_lag
from seriesloom.functions.stats import clean, divide, sample_mean
from seriesloom.meta import DecompTable, ForecastTable, Interval, ModelTable, SeriesFrame, join_on, quoted
from seriesloom.operators.temporal import future
from seriesloom.sources.saved import saved

from . import models as M
from .combination import Combination

#: A dot that stands for itself in a formula.
DOT = r"(?<![\w.])\.(?![\w.])"


def _prepared(frame: SeriesFrame, response: str, transform: Any) -> DataFrame:
    """Rows with __y (transformed, NaN is null) and __t (row number from 1)."""
    y = transform(clean(F.col(f"`{response}`").cast("double")))
    return frame.df.withColumn("__y", clean(y)).withColumn("__t", F.row_number().over(frame.window()))


def _steps(frame: SeriesFrame, index: Column) -> Column:
    """Index units since the epoch."""
    unit = frame.interval.unit
    if unit == "unit":
        return index
    if unit in ("day", "week"):
        return F.datediff(index.cast("date"), F.lit("1970-01-01").cast("date")) / (7 if unit == "week" else 1)
    if unit in ("month", "quarter", "year"):
        months = (F.year(index) - 1970) * 12 + F.month(index) - 1
        return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[unit])
    return F.unix_seconds(index.cast("timestamp")) / {"hour": 3600, "minute": 60, "second": 1}.get(unit, 1)


def lag_of(d: M.ModelDef, interval: Interval) -> int:
    return seasonal_lag(d.period, interval)


def model(frame: SeriesFrame, safely: bool = True, **defs: Any) -> ModelTable:
    """Fit every definition to every series.

    Closed-form models with the same response share one window and one
    aggregation by key.  Series that are too short, and Python models that
    raise, give a null model (``ok`` false) with the error; ``safely=False``
    raises instead.  Formulas for ``vars(a, b)`` fit each of the columns: the
    table is made longer, ``response`` ends the key and the response is ``value``.
    """
    if not defs:
        raise ValueError("a model table needs a model")
    plans = {k: d for k, d in defs.items() if isinstance(d, Combination)}
    plain = {k: _completed(frame, d) for k, d in defs.items() if k not in plans}
    if several := {M.parse_responses(d.formula) for d in plain.values()} - {()}:
        if len(several) > 1 or plans or not all(M.parse_responses(d.formula) for d in plain.values()):
            raise ValueError("models of several responses take the same ones, and no combinations")
        return model(frame.longer(several.pop()), safely, **{k: replace(d, formula=f"value ~ {d.rhs}") for k, d in plain.items()})
    for k, c in plans.items():
        plain |= {f"{k}__{i}": d for i, d in enumerate(c.defs)}
    responses = {d.response for d in plain.values()}
    if len(responses) != 1:
        raise ValueError(f"models of several responses: {sorted(responses)}")
    response = responses.pop()
    parts = []
    closed = {k: d for k, d in plain.items() if isinstance(d, M.ClosedForm)}
    if closed:
        parts.append(_fit_closed(frame, response, closed))
    for k, d in plain.items():
        if isinstance(d, M.SMEAN):
            parts.append(_fit_seasons(frame, response, k, d))
        elif isinstance(d, M.TSLM):
            parts.append(_fit_regression(frame, response, k, d))
        elif isinstance(d, M.PythonModel):
            parts.append(_fit_python(frame, response, k, d, safely))
    out = reduce(DataFrame.unionByName, parts)
    if not safely and (bad := out.filter(~F.col("ok")).first()):
        raise ValueError(f"{bad.model}: {bad.error}")
    placed = {k: c.placed([f"{k}__{i}" for i in range(len(c.defs))]) for k, c in plans.items()}
    return ModelTable(out, frame.key, frame.index, frame.interval, response, plain, frame, placed)


def _completed(frame: SeriesFrame, d: Any) -> Any:
    """The definition with a response, if its formula leaves it out, and with all other measured columns for a term ``.``."""
    left, tilde, right = (x.strip() for x in d.formula.partition("~"))
    left = left or frame.guess_response()
    if re.search(DOT, right):
        used = {left, *re.findall(r"\w+", left)}
        right = re.sub(DOT, " + ".join(c for c in frame.measured if c not in used) or "1", right)
    return replace(d, formula=f"{left} {tilde} {right}" if tilde else left)


def _finish(df: DataFrame, frame: SeriesFrame, name: Column, least: Column | int, obs: str = "obs") -> DataFrame:
    enough = F.col(obs) >= least
    return df.select(*quoted(frame.key), name.alias("model"), "n", "last", F.when(enough, F.col("state")).alias("state"), enough.alias("ok"), F.when(~enough, F.lit("too few values")).alias("error"))


def _fit_closed(frame: SeriesFrame, response: str, defs: Mapping[str, M.ClosedForm]) -> DataFrame:
    w = frame.window()
    size = F.count("*").over(Window.partitionBy(*quoted(frame.key)))
    df = frame.df.withColumn("__t", F.row_number().over(w)).withColumn("__r", size - F.col("__t") + 1)
    states = []
    for k, (name, d) in enumerate(defs.items()):
        m, y = lag_of(d, frame.interval), f"__y{k}"
        df = df.withColumn(y, clean(d.transformation(clean(F.col(f"`{response}`").cast("double")))))
        for g in d.lags(m):
            df = df.withColumn(f"__l{k}_{g}", F.lag(y, g).over(w))
        s = d.fit(F.col(y), F.col("__t"), _lags(k), F.col("__r"), m)
        least = max([d.least, *[g + 1 for g in d.lags(m)]])
        states.append(F.struct(F.lit(name).alias("model"), F.lit(least).alias("least"), F.count(y).alias("obs"), s.cast(M.STATE).alias("state")))
    got = df.groupBy(*quoted(frame.key)).agg(F.count("*").alias("n"), F.max(frame.index).alias("last"), F.array(*states).alias("__s"))
    rows = got.withColumn("__s", F.explode("__s")).select(*quoted(frame.key), "n", "last", "__s.*").withColumnRenamed("model", "__m")
    return _finish(rows, frame, F.col("__m"), F.col("least"))


def _lags(k: int) -> Any:
    return lambda g: F.col(f"__l{k}_{g}")


def _fit_seasons(frame: SeriesFrame, response: str, name: str, d: M.SMEAN) -> DataFrame:
    m = lag_of(d, frame.interval)
    df = _prepared(frame, response, d.transformation).withColumn("__s", ((F.col("__t") - 1) % m).cast("int"))
    per = df.groupBy(*quoted(frame.key), "__s").agg(F.avg("__y").alias("mean"), F.stddev_samp("__y").alias("sd"), F.count("__y").alias("obs"), F.count("*").alias("n"), F.max(frame.index).alias("last"))
    rows = F.array_sort(F.collect_list(F.struct("__s", "mean", "sd")))
    got = per.groupBy(*quoted(frame.key)).agg(rows.alias("r"), F.sum("obs").alias("obs"), F.sum("n").alias("n"), F.max("last").alias("last"))
    s = M.state(tail=F.transform("r", lambda x: x["mean"]), scale=F.transform("r", lambda x: x["sd"]))
    return _finish(got.withColumn("state", s.cast(M.STATE)), frame, F.lit(name), m)


def _lagged_columns(df: DataFrame, frame: SeriesFrame, d: M.TSLM) -> DataFrame:
    return df.withColumns({f"__lag_{x}_{g}": F.lag(x, g).over(frame.window()).cast("double") for x, g in d.lagged()})


def _fit_regression(frame: SeriesFrame, response: str, name: str, d: M.TSLM) -> DataFrame:
    df = _lagged_columns(_prepared(frame, response, d.transformation), frame, d)
    terms = d.terms(F.col("__t"), _steps(frame, F.col(f"`{frame.index}`")), float(lag_of(d, frame.interval)))
    p = len(terms)
    df = df.withColumns({f"__x{i}": c for i, c in enumerate(terms.values())})
    whole = reduce(lambda a, b: a & b, [F.col(f"__x{i}").isNotNull() for i in range(p)], F.col("__y").isNotNull())
    xs = [F.when(whole, F.col(f"__x{i}")) for i in range(p)]
    y = F.when(whole, F.col("__y"))
    xx = F.array(*[F.sum(xs[i] * xs[j]) for i in range(p) for j in range(i, p)])
    sums = df.groupBy(*quoted(frame.key)).agg(F.count("*").alias("n"), F.max(frame.index).alias("last"), F.count(y).alias("obs"), xx.alias("xx"), F.array(*[F.sum(x * y) for x in xs]).alias("xy"), F.sum(y * y).alias("yy"))
    key = list(frame.key)

    def solve(batches):
        at = np.triu_indices(p)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, coef, inv, s2, why = np.zeros((p, p)), None, None, None, None
                if r.obs < p or r.yy is None or any(v is None for v in r.xx):
                    why = "too few values"
                else:
                    a[at] = list(r.xx)
                    a = a + a.T - np.diag(np.diag(a))
                    try:
                        if np.linalg.matrix_rank(a) < p:
                            raise np.linalg.LinAlgError("regressors are collinear")
                        inv = np.linalg.inv(a)
                        coef = inv @ np.array(list(r.xy), float)
                        s2 = max(0.0, r.yy - float(coef @ np.array(list(r.xy), float))) / (r.obs - p) if r.obs > p else None
                    except np.linalg.LinAlgError as e:
                        coef, why = None, str(e)
                rows.append((None if coef is None else coef.tolist(), None if coef is None else inv.ravel().tolist(), s2, why))
            out = pdf[[*key, "n", "last"]].copy()
            out["coef"], out["inv"], out["s2"], out["why"] = ([x[i] for x in rows] for i in range(4))
            yield out

    schema = T.StructType([*[sums.schema[c] for c in [*key, "n", "last"]], *T._parse_datatype_string("coef array<double>, inv array<double>, s2 double, why string").fields])
    got = sums.mapInPandas(solve, schema)
    s = M.state(tail=F.col("coef"), scale=F.col("inv"), s2=F.col("s2")).cast(M.STATE)
    return got.select(*quoted(frame.key), F.lit(name).alias("model"), "n", "last", F.when(F.col("why").isNull(), s).alias("state"), F.col("why").isNull().alias("ok"), F.col("why").alias("error"))


def _fit_python(frame: SeriesFrame, response: str, name: str, d: M.PythonModel, safely: bool) -> DataFrame:
    df = _prepared(frame, response, d.transformation).select(*quoted([*frame.key, frame.index]), "__y")
    key, index, train, period = list(frame.key), frame.index, d.train, lag_of(d, frame.interval)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        blob, why = None, None
        try:
            blob = M.dump(train(pdf["__y"].to_numpy(float), period=period, index=pdf[index].to_numpy()))
        except Exception as e:  # a series without a model
            blob, why = None, str(e) or type(e).__name__
        return pd.DataFrame([[*pdf[key].iloc[0], len(pdf), pdf[index].iloc[-1], blob, why]], columns=[*key, "n", "last", "blob", "why"])

    schema = T.StructType([*[df.schema[k] for k in key], T.StructField("n", T.LongType()), T.StructField("last", df.schema[index].dataType), T.StructField("blob", T.BinaryType()), T.StructField("why", T.StringType())])
    got = df.groupBy(*quoted(key)).applyInPandas(run, schema)
    return got.select(*quoted(frame.key), F.lit(name).alias("model"), "n", "last", F.when(F.col("why").isNull(), M.state(blob=F.col("blob")).cast(M.STATE)).alias("state"), F.col("why").isNull().alias("ok"), F.col("why").alias("error"))


def _by_model(table: ModelTable, of: Any, otherwise: Column | None = None) -> Column:
    """One column that takes each model's own expression."""
    out = otherwise if otherwise is not None else F.lit(None).cast("double")
    for name, d in table.defs.items():
        x = of(name, d)
        if x is not None:
            out = F.when(F.col("model") == name, x).otherwise(out)
    return out


def forecast(table: ModelTable, h: int | str | None = None, new_data: SeriesFrame | None = None, point: Mapping[str, Any] | None = None, bootstrap: bool = False, simulate: bool = False, times: int = 1000, seed: int = 0) -> ForecastTable:
    """Distributions of all models for the next ``h`` rows or for the rows of ``new_data``.

    Series that ``new_data`` lacks get no forecasts; a scenario column leads the
    key.  Null models forecast null.  ``simulate`` gives samples of paths in
    place of normal distributions.  ``point`` names functions of (mean,
    median) columns; default is the mean.
    """
    if table.plans:
        table = saved(table, "models")  # fitted once, whatever the plans read of it
    key = list(table.key)
    if new_data is not None:
        extra = tuple(k for k in new_data.key if k not in key)
        w = Window.partitionBy(*quoted([*extra, *key])).orderBy(F.col(f"`{table.index}`"))
        rows = new_data.df.withColumn("h", F.row_number().over(w))
    else:
        extra = ()
        ends = table.df.select(*quoted(key), F.col("last").alias(table.index))
        rows = future(SeriesFrame(ends, table.key, table.index, table.interval), h).df
    rows = _lag_future(table, rows, extra)
    joined = join_on(rows, table.df.select(*quoted(key), "model", "n", "state", "ok"), key)
    s, n, hh = F.col("state"), F.col("n"), F.col("h")
    pairs = {k: _forecast_of(table, d, s, n, hh) for k, d in table.defs.items()}
    out = joined.withColumns({"mu": _by_model(table, lambda k, d: pairs[k][0]), "sigma": _by_model(table, lambda k, d: pairs[k][1])})
    if any(isinstance(d, M.PythonModel) for d in table.defs.values()):
        out = _python_forecast(table, out, [*extra, *key])
    keep = [c for c in rows.columns if not c.startswith("__lag_")]
    inverse = {k: d.transformation.inverse for k, d in table.defs.items() if not d.transformation.identity}
    mean = _by_model(table, lambda k, d: d.transformation.mean(F.col("mu"), F.col("sigma")))
    out = out.withColumn("mean", mean).select(*quoted(keep), "model", "mu", "sigma", "mean")
    fc = ForecastTable(out, (*extra, *table.key, "model"), table.index, table.interval, table.response, inverse)
    if simulate or bootstrap:
        fc = _sampled(table, fc, times, seed, bootstrap)
    fc = _plans(table, fc)
    return replace(fc, df=fc.df.withColumns({k: f(F.col("mean"), fc.back(F.col("mu"))) for k, f in (point or {}).items()}))


def _lag_future(table: ModelTable, rows: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """Earlier values of regressors: future rows are put behind the last training rows that they reach back to."""
    lagged = sorted({x for d in table.defs.values() if isinstance(d, M.TSLM) for x in d.lagged()})
    if not lagged or table.data is None:
        return rows
    far, names = max(g for _, g in lagged), sorted({x for x, _ in lagged})
    back = Window.partitionBy(*quoted(table.key)).orderBy(F.col(f"`{table.index}`").desc())
    tail = table.data.df.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") <= far).select(*quoted([*table.key, table.index, *names]))
    missing = [x for x in names if x not in rows.columns]
    both = rows.withColumns({x: F.lit(None).cast("double") for x in missing}).unionByName(tail, allowMissingColumns=True)
    w = Window.partitionBy(*quoted([*extra, *table.key])).orderBy(F.col(f"`{table.index}`"))
    return both.withColumns({f"__lag_{x}_{g}": F.lag(x, g).over(w).cast("double") for x, g in lagged}).filter("h is not null").drop(*missing)


def _forecast_of(table: ModelTable, d: Any, s: Column, n: Column, h: Column) -> tuple[Column | None, Column | None]:
    if isinstance(d, M.PythonModel):
        return None, None
    if isinstance(d, M.TSLM):
        return _regression(table, d, s, n + h)
    return d.forecast(s, n, h, lag_of(d, table.interval))


def _regression(table: ModelTable, d: M.TSLM, s: Column, t: Column) -> tuple[Column, Column]:
    frame = SeriesFrame(table.df, table.key, table.index, table.interval)
    x = F.array(*d.terms(t, _steps(frame, F.col(f"`{table.index}`")), float(lag_of(d, table.interval))).values())
    p = F.size(x)
    mu = F.aggregate(F.zip_with(x, s["tail"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    spread = F.aggregate(F.transform(s["scale"], lambda v, k: v * F.get(x, F.floor(k / p).cast("int")) * F.get(x, (k % p).cast("int"))), F.lit(0.0), lambda acc, v: acc + v)
    return mu, F.sqrt(s["s2"] * (1 + spread))


def _python_forecast(table: ModelTable, rows: DataFrame, key: list[str]) -> DataFrame:
    """Python models forecast all rows of a series at a time."""
    names = [k for k, d in table.defs.items() if isinstance(d, M.PythonModel)]
    mine, rest = rows.filter(F.col("model").isin(*names)), rows.filter(~F.col("model").isin(*names))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        if pdf["ok"].iloc[0]:
            mu, sigma = M.load(pdf["__blob"].iloc[0]).forecast(len(pdf))
            pdf["mu"], pdf["sigma"] = np.asarray(mu, float), np.asarray(sigma, float)
        return pdf.drop(columns="__blob")

    cols = [c for c in rows.columns if c != "state"]
    flat = mine.withColumn("__blob", F.col("state.blob")).select(*quoted(cols), "__blob")
    got = flat.groupBy(*quoted(key), "model").applyInPandas(run, T.StructType([rows.schema[c] for c in cols]))
    return rest.drop("state").unionByName(got)


def _plans(table: ModelTable, fc: ForecastTable) -> ForecastTable:
    """Combinations and reconciliations become further models; component models with generated names go."""
    hidden = {m for p in table.plans.values() for m in getattr(p, "hidden", ())}
    out = saved(fc, "forecasts") if table.plans else fc
    for name, plan in table.plans.items():
        out = plan.apply(name, table, out)
    if hidden:
        out = replace(out, df=out.df.filter(~F.col("model").isin(*hidden)))
    return out


def with_state(table: ModelTable, data: SeriesFrame | None = None) -> DataFrame:
    """Rows of the data with each model's state: __y, __t, lags of its response."""
    frame = data or table.data
    if frame is None:
        raise ValueError("the model table holds no data: pass them")
    w = frame.window()
    df = frame.df.withColumn("__t", F.row_number().over(w)).withColumn("__v", clean(F.col(f"`{table.response}`").cast("double")))
    gaps = sorted({g for d in table.defs.values() if isinstance(d, M.ClosedForm) for g in d.lags(lag_of(d, table.interval))})
    df = df.withColumns({f"__v{g}": F.lag("__v", g).over(w) for g in gaps})
    for d in table.defs.values():
        if isinstance(d, M.TSLM):
            df = _lagged_columns(df, frame, d)
    return join_on(df, table.df.select(*quoted(table.key), "model", "n", "state", "ok"), table.key)


def augment(table: ModelTable, data: SeriesFrame | None = None) -> SeriesFrame:
    """Index, response, fitted and resid (response scale) and innov (transformed scale) of every model."""
    df = with_state(table, data)
    s, t = F.col("state"), F.col("__t")

    def link(name: str, d: Any) -> Column | None:
        if isinstance(d, M.PythonModel):
            return None
        if isinstance(d, M.TSLM):
            return _regression(table, d, s, t)[0]
        return d.fitted(s, t, lambda g: d.transformation(F.col(f"__v{g}")), lag_of(d, table.interval))

    df = df.withColumn("__f", _by_model(table, link))
    names = [k for k, d in table.defs.items() if isinstance(d, M.PythonModel)]
    if names:
        df = _python_fitted(table, df, names)
    fitted = _by_model(table, lambda k, d: d.transformation.inverse(F.col("__f")) if not d.transformation.identity else F.col("__f"))
    moved = _by_model(table, lambda k, d: d.transformation(F.col("__v")) - F.col("__f"))
    df = df.withColumns({"fitted": fitted, "innov": moved}).withColumn("resid", F.col("__v") - F.col("fitted"))
    out = SeriesFrame(df.select(*quoted(table.key), "model", F.col(f"`{table.index}`"), F.col("__v").alias(table.response), "fitted", "resid", "innov"), (*table.key, "model"), table.index, table.interval)
    for name, plan in table.plans.items():
        if isinstance(plan, Combination):
            out = plan.augmented(name, table, out)
    hidden = {m for p in table.plans.values() for m in getattr(p, "hidden", ())}
    return replace(out, df=out.df.filter(~F.col("model").isin(*hidden))) if hidden else out


def _python_fitted(table: ModelTable, df: DataFrame, names: list[str]) -> DataFrame:
    mine, rest = df.filter(F.col("model").isin(*names)), df.filter(~F.col("model").isin(*names))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__t")
        if pdf["ok"].iloc[0]:
            pdf["__f"] = np.asarray(M.load(pdf["__blob"].iloc[0]).fitted(), float)
        return pdf.drop(columns="__blob")

    cols = [c for c in df.columns if c != "state"]
    got = mine.withColumn("__blob", F.col("state.blob")).select(*quoted(cols), "__blob").groupBy(*quoted(table.key), "model").applyInPandas(run, T.StructType([df.schema[c] for c in cols]))
    return rest.drop("state").unionByName(got)


def fitted(table: ModelTable, h: int = 1) -> SeriesFrame:
    """Fitted values; for h > 1 the forecasts made h rows earlier from what was known then (models without such a form are fitted to every beginning of a series)."""
    if h == 1:
        a = augment(table)
        return replace(a, df=a.df.select(*quoted(a.key), F.col(f"`{a.index}`"), "fitted"))
    frame = table.data
    w = frame.window()
    df = frame.df.withColumn("__v", clean(F.col(f"`{table.response}`").cast("double"))).withColumn("__t", F.row_number().over(w))
    known = w.rowsBetween(Window.unboundedPreceding, -h)
    parts = []
    for name, d in table.defs.items():
        y = d.transformation(F.col("__v"))
        m = lag_of(d, table.interval)
        if isinstance(d, M.MEAN):
            f = F.avg(y).over(known)
        elif isinstance(d, M.NAIVE):
            f = F.lag(y, h).over(w)
        elif isinstance(d, M.DRIFT):
            first, n = F.first(y).over(known), F.col("__t") - h
            f = F.lag(y, h).over(w) + h * F.when(n > 1, (F.lag(y, h).over(w) - first) / (n - 1))
        elif isinstance(d, M.SNAIVE):
            f = F.lag(y, m * math.ceil(h / m)).over(w)
        elif isinstance(d, M.SMEAN):
            season = Window.partitionBy(*quoted(frame.key), ((F.col("__t") - 1) % m)).orderBy("__t").rangeBetween(Window.unboundedPreceding, -h)
            f = F.avg(y).over(season)
        elif isinstance(d, M.TREND):
            x = F.when(y.isNotNull(), F.col("__t").cast("double"))
            n, sx, sy, sxx, sxy = (c.over(known) for c in (F.count(y), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y)))
            slope = divide(n * sxy - sx * sy, n * sxx - sx * sx)
            f = F.when(n > 1, (sy - slope * sx) / n + slope * F.col("__t"))
        elif isinstance(d, M.NULL):
            f = F.lit(None).cast("double")
        else:
            parts.append(_refitted(table, df.withColumn("__y", clean(y)), name, d, h))
            continue
        parts.append(df.select(*quoted(frame.key), F.lit(name).alias("model"), F.col(f"`{frame.index}`"), d.transformation.inverse(f).alias("fitted")))
    return SeriesFrame(reduce(DataFrame.unionByName, parts), (*frame.key, "model"), frame.index, frame.interval)


def _refitted(table: ModelTable, df: DataFrame, name: str, d: Any, h: int) -> DataFrame:
    """Forecasts h rows ahead from fits to every beginning of a series, a series in a task; null where a fit fails."""
    frame, key, index = table.data, list(table.key), table.index
    if isinstance(d, M.TSLM):
        terms = d.terms(F.col("__t"), _steps(frame, F.col(f"`{index}`")), float(lag_of(d, table.interval)))
        df = _lagged_columns(df, frame, d).withColumn("__x", F.array(*terms.values()))
    else:
        df = df.withColumn("__x", F.array().cast("array<double>"))
    train, period = getattr(d, "train", None), lag_of(d, table.interval)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__t")
        y, out = pdf["__y"].to_numpy(float), np.full(len(pdf), np.nan)
        if train is None:
            x = np.array([[np.nan if v is None else v for v in r] for r in pdf["__x"]], float)
            whole = ~np.isnan(y) & ~np.isnan(x).any(1)
            for i in range(x.shape[1], len(y) - h + 1):
                a, b = x[:i][whole[:i]], y[:i][whole[:i]]
                if len(b) >= x.shape[1] and np.linalg.matrix_rank(a) == x.shape[1]:
                    out[i + h - 1] = x[i + h - 1] @ np.linalg.lstsq(a, b, rcond=None)[0]
        else:
            for i in range(1, len(y) - h + 1):
                try:
                    out[i + h - 1] = train(y[:i], period=period, index=pdf[index].to_numpy()[:i]).forecast(h)[0][h - 1]
                except Exception:  # a beginning without a model
                    continue
        pdf["fitted"] = out
        return pdf[[*key, index, "fitted"]]

    cols = df.select(*quoted([*key, index]), "__t", "__y", "__x")
    schema = T.StructType([*[cols.schema[c] for c in [*key, index]], T.StructField("fitted", T.DoubleType())])
    got = cols.groupBy(*quoted(key)).applyInPandas(run, schema)
    return got.select(*quoted(key), F.lit(name).alias("model"), F.col(f"`{index}`"), d.transformation.inverse(clean(F.col("fitted"))).alias("fitted"))


def residuals(table: ModelTable, type: str = "innovation") -> SeriesFrame:
    a = augment(table)
    return replace(a, df=a.df.select(*quoted(a.key), F.col(f"`{a.index}`"), F.col("innov" if type == "innovation" else "resid").alias("resid")))


def response(table: ModelTable) -> SeriesFrame:
    f = table.data
    return replace(f, df=f.df.select(*quoted(f.key), F.col(f"`{f.index}`"), clean(F.col(f"`{table.response}`").cast("double")).alias("response")))


def glance(table: ModelTable) -> DataFrame:
    """One row for each series and model: rows, residual variance, status."""
    return table.df.select(*quoted(table.key), "model", "n", F.col("state.s2").alias("sigma2"), "ok")


def tidy(table: ModelTable) -> DataFrame:
    """(key, model, term, estimate) of models with coefficients."""
    terms = []
    for name, d in table.defs.items():
        if isinstance(d, M.TSLM):
            names = list(d.terms(F.lit(1), F.lit(1), float(lag_of(d, table.interval))))
            own = {t: (lambda s, i=i: F.get(s["tail"], F.lit(i))) for i, t in enumerate(names)}
        elif hasattr(d, "tidy"):
            own = d.tidy(lag_of(d, table.interval))
        else:
            own = {}
        terms += [(name, t, f) for t, f in own.items()]
    rows = [F.when(F.col("model") == name, F.struct(F.lit(t).alias("term"), f(F.col("state")).alias("estimate"))) for name, t, f in terms]
    if not rows:
        return table.df.select(*quoted(table.key), "model", F.lit("").alias("term"), F.lit(0.0).alias("estimate")).limit(0)
    out = table.df.filter("ok").select(*quoted(table.key), "model", F.explode(F.array_compact(F.array(*rows))).alias("__r"))
    return out.select(*quoted(table.key), "model", "__r.term", "__r.estimate")


coef = tidy


def refit(table: ModelTable, data: SeriesFrame) -> ModelTable:
    """The same definitions fitted to other data; combinations and reconciliations stay."""
    new = model(data, **table.defs)
    return replace(new, plans=table.plans)


def interpolate(table: ModelTable, data: SeriesFrame | None = None) -> SeriesFrame:
    """Missing responses become fitted values of the one model."""
    if len(table.models) != 1:
        raise ValueError("interpolation takes one model")
    a, frame = augment(table, data), data or table.data
    filled = a.df.select(*quoted(frame.key), F.col(f"`{frame.index}`"), F.coalesce(table.response, "fitted").alias(table.response))
    other = [c for c in frame.df.columns if c != table.response]
    return replace(frame, df=join_on(frame.df.select(*quoted(other)), filled, [*frame.key, frame.index]).select(*quoted(frame.df.columns)))


def generate(table: ModelTable, h: int | str | None = None, times: int = 1, seed: int = 0, bootstrap: bool = False, block: int = 1, new_data: SeriesFrame | None = None) -> SeriesFrame:
    """Simulated paths: key, model, rep, index, sim. Reruns with a seed agree.

    Paths of NAIVE, DRIFT and SNAIVE add up innovations within each season;
    others scatter around the mean; Python models may give their own.
    ``bootstrap`` draws centred residuals,
    in blocks of ``block`` rows, in place of normal innovations; residuals are
    numbered by series and joined by number, none are gathered.  ``new_data``
    gives the rows to simulate.  A combination's paths are its weighted parts'.
    """
    plain = replace(table, plans={})
    fc = forecast(plain, h, new_data)
    key = [k for k in fc.key if k != "model"]
    rows = join_on(fc.df, table.df.select(*quoted(table.key), "model", "n", F.col("state.s2").alias("__s2")), [*table.key, "model"])
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times))))
    m = F.lit(1)
    walks = F.lit(False)
    for name, d in table.defs.items():
        if isinstance(d, M.NAIVE | M.DRIFT | M.SNAIVE):
            walks = walks | (F.col("model") == name)
            if isinstance(d, M.SNAIVE):
                m = F.when(F.col("model") == name, lag_of(d, table.interval)).otherwise(m)
    ids = [*quoted(key), F.col("model"), F.col("rep")]
    if bootstrap:
        res = residuals(plain).df.filter("resid is not null")
        w = Window.partitionBy(*quoted(table.key), "model")
        res = res.withColumn("e", F.col("resid") - F.avg("resid").over(w)).withColumn("at", F.row_number().over(w.orderBy(F.col(f"`{table.index}`"))) - 1)
        size = res.groupBy(*quoted(table.key), "model").agg(F.count("*").alias("__m"))
        start = F.pmod(F.xxhash64(F.lit(seed), *ids, F.floor((F.col("h") - 1) / block)), F.col("__m"))
        rows = join_on(rows, size, [*table.key, "model"], "left").withColumn("at", F.pmod(start + (F.col("h") - 1) % block, F.col("__m")).cast("int"))
        rows = join_on(rows, res.select(*quoted(table.key), "model", "at", "e"), [*table.key, "model", "at"], "left")
    else:
        # two uniform numbers from hashes of the row's identity: a rerun, or a lost executor's task, draws the same
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *ids, "h"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1) for k in (1, 2)]
        normal = F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1])
        rows = rows.withColumn("e", normal * F.when(walks, F.sqrt("__s2")).otherwise(F.col("sigma")))
    season = (F.col("h") - 1) % m
    run = Window.partitionBy(*quoted(key), "model", "rep", season).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    path = F.col("mu") + F.when(walks, F.sum("e").over(run)).otherwise(F.col("e"))
    out = rows.withColumn("__sim", path).select(*quoted(key), "model", "rep", F.col(f"`{table.index}`"), "h", "__sim")
    own = [k for k, d in table.defs.items() if isinstance(d, M.PythonModel)]
    if own and not bootstrap:
        out = _python_paths(table, out, own, key, seed)
    out = out.select(*quoted(key), "model", "rep", F.col(f"`{table.index}`"), "h", fc.back(F.col("__sim")).alias("sim"), F.col("__sim").alias("sim_link"))
    for name, plan in table.plans.items():
        if isinstance(plan, Combination):
            out = out.unionByName(plan.paths(name, table, out, key))
    hidden = {x for p in table.plans.values() for x in getattr(p, "hidden", ())}
    out = out.filter(~F.col("model").isin(*hidden)) if hidden else out
    return SeriesFrame(out, (*key, "model", "rep"), table.index, table.interval)


def _python_paths(table: ModelTable, rows: DataFrame, names: list[str], key: list[str], seed: int) -> DataFrame:
    """Paths of models with a ``simulate(h, rng)``; the generator is seeded by the row's identity."""
    mine, rest = rows.filter(F.col("model").isin(*names)), rows.filter(~F.col("model").isin(*names))
    flat = join_on(mine, table.df.select(*quoted(table.key), "model", F.col("state.blob").alias("__blob")), [*table.key, "model"])
    flat = flat.withColumn("__seed", F.pmod(F.xxhash64(F.lit(seed), *quoted(key), "model", "rep"), F.lit(1 << 52)))

    cols = rows.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        fit = M.load(pdf["__blob"].iloc[0]) if pdf["__blob"].iloc[0] is not None else None
        if hasattr(fit, "simulate"):
            pdf["__sim"] = np.asarray(fit.simulate(len(pdf), np.random.default_rng(int(pdf["__seed"].iloc[0]))), float)
        return pdf[cols]

    return rest.unionByName(flat.groupBy(*quoted(key), "model", "rep").applyInPandas(run, rows.schema))


def _sampled(table: ModelTable, fc: ForecastTable, times: int, seed: int, bootstrap: bool) -> ForecastTable:
    """Samples in place of normal distributions: one array for each (key, model, index)."""
    n = fc.df.agg(F.max("h")).first()[0] or 1
    paths = generate(table, n, times, seed, bootstrap).df
    got = paths.groupBy(*quoted(table.key), "model", "h").agg(F.array_sort(F.collect_list(F.struct("rep", "sim"))).alias("__s"))
    got = got.select(*quoted(table.key), "model", "h", F.transform("__s", lambda x: x["sim"]).alias("sample"))
    out = join_on(fc.df, got, [*table.key, "model", "h"], "left").withColumn("mean", F.coalesce(sample_mean(F.col("sample")), F.col("mean")))
    return replace(fc, df=out)


def components(table: ModelTable) -> DecompTable:
    """Trend, season and remainder of SMEAN and TREND models; Python models give their own."""
    a = augment(table)
    parts = []
    for name, d in table.defs.items():
        if isinstance(d, M.PythonModel):
            continue
        label = "season" if isinstance(d, M.SMEAN | M.SNAIVE) else "level"
        other = "level" if label == "season" else "season"
        parts.append(a.df.filter(F.col("model") == name).select(*quoted(a.key), F.col(f"`{a.index}`"), F.col(table.response), F.col("fitted").alias(label), F.lit(0.0).alias(other), F.col("resid").alias("remainder")))
    if names := [k for k, d in table.defs.items() if isinstance(d, M.PythonModel)]:
        parts.append(_python_components(table, a, names))
    out = reduce(DataFrame.unionByName, parts)
    return DecompTable(out, a.key, a.index, a.interval, table.response, "fitted", {}, {table.response: "level + season + remainder"})


def _python_components(table: ModelTable, a: SeriesFrame, names: list[str]) -> DataFrame:
    """What the models' ``components()`` give of level and season, one value a row; the level is the fitted value without it."""
    index, response_ = a.index, table.response
    cols = [*a.key, index, response_, "fitted"]
    rows = join_on(a.df.filter(F.col("model").isin(*names)).select(*quoted(cols)), table.df.select(*quoted(table.key), "model", F.col("state.blob").alias("__blob")), [*table.key, "model"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        fit = M.load(pdf["__blob"].iloc[0]) if pdf["__blob"].iloc[0] is not None else None
        given = dict(fit.components()) if hasattr(fit, "components") else {}
        pdf["level"], pdf["season"] = given.get("level", pdf["fitted"]), given.get("season", 0.0)
        pdf["remainder"] = pdf[response_] - pdf["level"] - pdf["season"]
        return pdf.drop(columns=["fitted", "__blob"])

    number = T.DoubleType()
    schema = T.StructType([*[rows.schema[c] for c in cols[:-1]], *[T.StructField(c, number) for c in ("level", "season", "remainder")]])
    return rows.groupBy(*quoted(a.key)).applyInPandas(run, schema)


def outliers(table: ModelTable, limit: float = 3.0) -> DataFrame:
    """Rows whose innovation is over ``limit`` standard deviations of the model's innovations."""
    a = augment(table)
    sd = F.stddev_samp("innov").over(Window.partitionBy(*quoted(a.key)))
    return a.df.withColumn("__sd", sd).filter(F.abs("innov") > limit * F.col("__sd")).drop("__sd")


def hypothesize(table: ModelTable, tests: Mapping[str, Any]) -> DataFrame:
    """Tests of the innovations: named functions of (value, previous value) columns to named aggregates; one row a series, model and test."""
    a = augment(table)
    df = a.df.withColumn("__b", F.lag("innov").over(a.window()))
    rows = []
    for name, f in tests.items():
        got = df.groupBy(*quoted(a.key)).agg(*[c.alias(k) for k, c in f(F.col("innov"), F.col("__b")).items()])
        rows.append(got.withColumn("test", F.lit(name)))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)


def ljung_box(y: Column, before: Column) -> dict[str, Column]:
    """Portmanteau statistic of lag one."""
    from seriesloom.operators.features import lag_one

    n, r = F.count(y), lag_one(y, before)
    return {"statistic": n * (n + 2) * r * r / (n - 1)}


def irf(table: ModelTable, h: int = 10) -> DataFrame:
    """Response of the forecasts to an impulse of one in the last value: 1 for walks, 1 / n for means, by season."""
    rows = table.df.filter("ok").withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))

    def one(name: str, d: Any) -> Column | None:
        m = lag_of(d, table.interval)
        if isinstance(d, M.NAIVE):
            return F.lit(1.0)
        if isinstance(d, M.DRIFT):
            return 1 + F.col("h") / (F.col("n") - 1)
        if isinstance(d, M.SNAIVE):
            return F.when(F.col("h") % m == 0, 1.0).otherwise(0.0)
        if isinstance(d, M.MEAN):
            return 1 / F.col("n")
        return None

    out = rows.select(*quoted(table.key), "model", "h", _by_model(table, one).alias("response"))
    own = [k for k, d in table.defs.items() if isinstance(d, M.PythonModel)]
    if not own:
        return out
    blobs = table.df.filter("ok").filter(F.col("model").isin(*own)).select(*quoted(table.key), "model", F.col("state.blob").alias("__blob"))
    key = list(table.key)

    def impulses(batches):
        for pdf in batches:
            parts = []
            for r in pdf.to_dict("records"):
                fit = M.load(r["__blob"])
                if hasattr(fit, "irf"):
                    parts += [[*[r[k] for k in key], r["model"], k + 1, float(v)] for k, v in enumerate(fit.irf(h))]
            yield pd.DataFrame(parts, columns=[*key, "model", "h", "response"])

    schema = T.StructType([*[blobs.schema[c] for c in [*key, "model"]], T.StructField("h", T.IntegerType()), T.StructField("response", T.DoubleType())])
    return out.filter(~F.col("model").isin(*own)).unionByName(blobs.mapInPandas(impulses, schema))


def report(table: ModelTable) -> str:
    """Text for a single model; many models are told to use glance()."""
    rows = table.df.limit(2).collect()
    if len(rows) != 1:
        return "many models: see glance()"
    r = rows[0]
    return f"Series: {table.response}\nModel: {model_sum(table.defs[r.model])}\nrows: {r.n}, residual variance: {r.state.s2 if r.state else None}"


def model_sum(d: Any) -> str:
    return type(d).__name__ if not isinstance(d, Combination) else "COMBINATION"


def equation(table: ModelTable) -> str:
    """The equation of a single, untransformed model in TeX."""
    if len(table.defs) != 1:
        raise ValueError("equation() takes one model")
    d = next(iter(table.defs.values()))
    if not d.transformation.identity:
        raise ValueError("equation() takes no transformations")
    forms = {"MEAN": r"y_t = c + \varepsilon_t", "NAIVE": r"y_t = y_{t-1} + \varepsilon_t", "DRIFT": r"y_t = c + y_{t-1} + \varepsilon_t", "SNAIVE": r"y_t = y_{t-m} + \varepsilon_t", "TREND": r"y_t = a + b t + \varepsilon_t"}
    return forms.get(type(d).__name__, rf"y_t = {d.rhs} + \varepsilon_t")
