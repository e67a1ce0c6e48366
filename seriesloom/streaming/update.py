"""Fitted models that take in new rows: in batches, and by Structured Streaming with state for each series."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.stats import clean
from seriesloom.meta import ModelTable, SeriesFrame, join_on, quoted
from seriesloom.plans import models as M
from seriesloom.plans.lifecycle import lag_of, model


def _merged(n0: Column, m0: Column, s0: Column, n1: Column, m1: Column, s1: Column) -> tuple[Column, Column]:
    """Mean and sum of squared deviations of two groups together; an empty one changes nothing."""
    n0, n1 = F.coalesce(n0, F.lit(0)), F.coalesce(n1, F.lit(0))
    m0, m1, s0, s1 = (F.coalesce(x, F.lit(0.0)) for x in (m0, m1, s0, s1))
    n, d = n0 + n1, m1 - m0
    return F.when(n > 0, m0 + d * n1 / n), F.when(n > 0, s0 + s1 + d * d * n0 * n1 / n)


def stream(table: ModelTable, new: SeriesFrame) -> ModelTable:
    """The models after the rows of ``new``, which follow the training rows of their series.

    MEAN, NAIVE, DRIFT and SNAIVE are updated from their state and the new rows
    alone and then equal a fit to all rows, missing values among them;
    other models are fitted again to old and new rows.  Null models only count
    rows.  Series without new rows, and models of series without old ones, stay.
    """
    key, index = list(table.key), table.index
    quick = {k: d for k, d in table.defs.items() if isinstance(d, M.MEAN | M.NAIVE | M.DRIFT | M.SNAIVE | M.NULL)}
    parts: list[DataFrame] = []
    for name, d in quick.items():
        parts.append(_updated(table, new, name, d, key, index))
    own = {k: d for k, d in table.defs.items() if isinstance(d, M.PythonModel)}
    for name, d in own.items():
        parts.append(_python_update(table, new, name, d, key, index))
    slow = {k: d for k, d in table.defs.items() if k not in quick and k not in own}
    data = table.data.union(new) if table.data is not None else None
    if slow:
        if data is None:
            raise ValueError("these models are fitted again and need the old rows")
        parts.append(model(data, **slow).df)
    return replace(table, df=reduce(DataFrame.unionByName, parts), data=data)


def _updated(table: ModelTable, new: SeriesFrame, name: str, d: Any, key: list[str], index: str) -> DataFrame:
    old = table.df.filter(F.col("model") == name)
    y = clean(d.transformation(clean(F.col(f"`{table.response}`").cast("double"))))
    rows = new.df.select(*quoted([*key, index]), y.alias("y"))
    m = 1 if isinstance(d, M.NAIVE | M.DRIFT) else lag_of(d, table.interval)
    if isinstance(d, M.MEAN | M.NULL):
        got = rows.groupBy(*quoted(key)).agg(F.count("*").alias("k"), F.max(index).alias("end"), F.count("y").alias("c"), F.avg("y").alias("m1"), F.var_pop("y").alias("v1"))
        j = join_on(old, got, key, "left")
        n0 = F.coalesce("state.spread", F.lit(0.0))
        mean, ss = _merged(n0, F.col("state.a"), F.col("state.s2") * (n0 - 1), F.col("c"), F.col("m1"), F.col("v1") * F.col("c"))
        s = M.state() if isinstance(d, M.NULL) else M.state(a=mean, s2=F.when(n0 + F.col("c") > 1, ss / (n0 + F.col("c") - 1)), spread=n0 + F.col("c"))
    else:
        back = Window.partitionBy(*quoted(key)).orderBy(F.col("__o").desc())
        w = Window.partitionBy(*quoted(key)).orderBy("__o")
        tail = old.select(*quoted(key), F.posexplode("state.tail").alias("p", "y")).select(*quoted(key), F.struct(F.lit(None).cast(new.df.schema[index].dataType).alias("i"), F.col("p").alias("p")).alias("__o"), "y", F.lit(False).alias("__new"))
        both = tail.unionByName(rows.select(*quoted(key), F.struct(F.col(f"`{index}`").alias("i"), F.lit(0).alias("p")).alias("__o"), "y", F.lit(True).alias("__new")))
        both = both.withColumns({"__d": F.when(F.col("__new"), F.col("y") - F.lag("y", m).over(w)), "__r": F.row_number().over(back)})
        last = F.array_sort(F.collect_list(F.when(F.col("__r") <= m, F.struct((-F.col("__r")).alias("r"), F.col("y").alias("y")))))
        got = both.groupBy(*quoted(key)).agg(F.sum(F.col("__new").cast("long")).alias("k"), F.max("__o.i").alias("end"), last.alias("__tail"), F.count("__d").alias("c"), F.avg("__d").alias("m1"), F.var_pop("__d").alias("v1"), F.avg(F.col("__d") * F.col("__d")).alias("q1"))
        j = join_on(old, got, key, "left")
        n0 = F.coalesce("state.spread", F.lit(0.0))
        new_tail = F.transform("__tail", lambda x: x["y"])
        if isinstance(d, M.DRIFT):
            mean, ss = _merged(n0, F.col("state.b"), F.col("state.s2") * (n0 - 1), F.col("c"), F.col("m1"), F.col("v1") * F.col("c"))
            s = M.state(tail=new_tail, b=mean, s2=F.when(n0 + F.col("c") > 1, ss / (n0 + F.col("c") - 1)), spread=n0 + F.col("c"))
        else:
            total = F.coalesce(F.col("state.s2") * n0, F.lit(0.0)) + F.coalesce(F.col("q1") * F.col("c"), F.lit(0.0))
            s = M.state(tail=new_tail, s2=F.when(n0 + F.col("c") > 0, total / (n0 + F.col("c"))), spread=n0 + F.col("c"))
    fresh = F.col("k") > 0
    return j.select(*quoted(key), "model", (F.col("n") + F.coalesce("k", F.lit(0))).cast("long").alias("n"), F.greatest("last", "end").alias("last"), F.when(fresh & F.col("ok"), s.cast(M.STATE)).otherwise(F.col("state")).alias("state"), "ok", "error")


def _python_update(table: ModelTable, new: SeriesFrame, name: str, d: M.PythonModel, key: list[str], index: str) -> DataFrame:
    """Models of the user's by their ``update(y)``; those without one are trained again on old and new rows."""
    y = clean(d.transformation(clean(F.col(f"`{table.response}`").cast("double")))).alias("y")
    rows = new.df.select(*quoted([*key, index]), y, F.lit(True).alias("__fresh"))
    if table.data is not None:
        rows = rows.unionByName(table.data.df.select(*quoted([*key, index]), y, F.lit(False).alias("__fresh")))
    old = table.df.filter(F.col("model") == name)
    flat = join_on(rows, old.select(*quoted(key), "ok", F.col("state.blob").alias("blob")), key)
    train, period, keep = d.train, lag_of(d, table.interval), table.data is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        blob, fresh, why = pdf["blob"].iloc[0], pdf[pdf["__fresh"]], None
        if len(fresh):
            try:
                fit = M.load(blob) if blob is not None else None
                if hasattr(fit, "update"):
                    blob = M.dump(fit.update(fresh["y"].to_numpy(float)))
                elif keep:
                    blob = M.dump(train(pdf["y"].to_numpy(float), period=period, index=pdf[index].to_numpy()))
                else:
                    raise ValueError("these models have no update() and need the old rows")
            except Exception as e:  # a series without a model
                blob, why = None, str(e) or type(e).__name__
        return pd.DataFrame([[*pdf[key].iloc[0], len(fresh), pdf[index].iloc[-1], blob, why]], columns=[*key, "__k", "__end", "__fit", "__why"])

    schema = T.StructType([*[flat.schema[k] for k in key], T.StructField("__k", T.LongType()), T.StructField("__end", flat.schema[index].dataType), T.StructField("__fit", T.BinaryType()), T.StructField("__why", T.StringType())])
    j = join_on(old, flat.groupBy(*quoted(key)).applyInPandas(run, schema), key, "left")
    ok = F.when(F.col("__k").isNull(), F.col("ok")).otherwise(F.col("__fit").isNotNull())
    fitted_state = F.when(F.col("__fit").isNotNull(), M.state(blob=F.col("__fit")).cast(M.STATE))
    return j.select(*quoted(key), "model", (F.col("n") + F.coalesce("__k", F.lit(0))).cast("long").alias("n"), F.greatest("last", "__end").alias("last"), F.when(F.col("__k").isNull(), F.col("state")).otherwise(fitted_state).alias("state"), ok.alias("ok"), F.coalesce("__why", "error").alias("error"))


def seasonal_state(rows: DataFrame, key: list[str], index: str, value: str, period: int, epoch: str = "1970-01-01") -> DataFrame:
    """Seasonal means of a stream of daily rows: (key, n, sums, squares, means) of each series that a batch changed.

    State by series is the count, sum and sum of squares of each season (days
    since ``epoch`` modulo ``period``), so batches of any shape give the same
    state as one fit to all rows.  Works on streaming and, for tests, batch
    tables through :func:`seasonal_sums`.
    """
    day = F.datediff(F.col(f"`{index}`").cast("date"), F.lit(epoch).cast("date"))
    df = rows.select(*quoted(key), F.pmod(day, F.lit(period)).cast("int").alias("s"), clean(F.col(f"`{value}`").cast("double")).alias("y")).filter("y is not null")
    out = T.StructType([*[df.schema[k] for k in key], *T._parse_datatype_string("n long, counts array<long>, sums array<double>, squares array<double>, means array<double>").fields])
    kept = "counts array<long>, sums array<double>, squares array<double>"

    def update(k: tuple, pdfs: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        c, s, q = (np.array(x) for x in state.get) if state.exists else (np.zeros(period, np.int64), np.zeros(period), np.zeros(period))
        for pdf in pdfs:
            at, y = pdf["s"].to_numpy(), pdf["y"].to_numpy(float)
            c = c + np.bincount(at, minlength=period)
            s = s + np.bincount(at, y, period)
            q = q + np.bincount(at, y * y, period)
        state.update((c.tolist(), s.tolist(), q.tolist()))
        means = [float(a) / int(b) if b else None for a, b in zip(s, c, strict=True)]
        yield pd.DataFrame([[*k, int(c.sum()), c.tolist(), s.tolist(), q.tolist(), means]], columns=out.names)

    return df.groupBy(*quoted(key)).applyInPandasWithState(update, out, kept, "update", "NoTimeout")


def seasonal_sums(rows: DataFrame, key: list[str], index: str, value: str, period: int, epoch: str = "1970-01-01") -> DataFrame:
    """(key, season, n, mean, sd) of a batch table, by the same seasons."""
    day = F.datediff(F.col(f"`{index}`").cast("date"), F.lit(epoch).cast("date"))
    y = clean(F.col(f"`{value}`").cast("double"))
    return rows.groupBy(*quoted(key), F.pmod(day, F.lit(period)).cast("int").alias("season")).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"))
