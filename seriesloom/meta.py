"""Tables with roles: series, models, forecasts, decompositions.

Each wrapper is a DataFrame with driver-side metadata.  Verbs keep the roles
where the columns survive and otherwise return the plainer type, a bare
DataFrame at last.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECONDS = {"week": 604800.0, "day": 86400.0, "hour": 3600.0, "minute": 60.0, "second": 1.0, "millisecond": 1e-3, "microsecond": 1e-6, "nanosecond": 1e-9}
MONTHS = {"year": 12, "quarter": 3, "month": 1}


@dataclass(frozen=True)
class Interval:
    """Spacing of an index: ``n`` units; n = 0 stands for an irregular index, unit ``unit`` for plain numbers."""

    unit: str = "day"
    n: float = 1

    def step(self, index: Column, k: Column) -> Column:
        """The index ``k`` steps later."""
        if self.unit == "unit":
            return index + k * self.n
        if self.unit in MONTHS:
            return F.add_months(index, (k * int(self.n * MONTHS[self.unit])).cast("int"))
        if self.unit in ("day", "week"):
            return F.date_add(index, (k * int(self.n * SECONDS[self.unit] // 86400)).cast("int"))
        micros = (k * int(round(self.n * SECONDS[self.unit] * 1e6))).cast("long")
        return (F.timestamp_micros(F.unix_micros(index.cast("timestamp")) + micros)).cast("timestamp_ntz")


def quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by columns of equal names; null keys (aggregated or missing ones) match each other.

    Without keys ``right`` has few rows, one for each model: it is paired with all of ``left``.
    """
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    if not keys:
        return left.join(F.broadcast(other), how="cross" if how == "inner" else how, on=F.lit(True) if how != "inner" else None)
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__right_{k}`")) for k in keys])
    return left.join(other, on, how).drop(*[f"__right_{k}" for k in keys])


@dataclass(frozen=True)
class SeriesFrame:
    """Keyed series: one row for each (key, index)."""

    df: DataFrame
    key: tuple[str, ...]
    index: str
    interval: Interval = Interval()
    groups: tuple[str, ...] = field(default=(), kw_only=True)

    def window(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*quoted((*self.key, *more))).orderBy(*quoted([self.index]))

    @property
    def measured(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.key and c != self.index]

    def guess_response(self) -> str:
        """The first measured column that holds numbers."""
        for f in self.df.schema.fields:
            if f.name in self.measured and isinstance(f.dataType, T.NumericType):
                return f.name
        raise ValueError("no measured column holds numbers")

    def duplicates(self) -> DataFrame:
        """(key, index, count) that do not identify a row."""
        return self.df.groupBy(*quoted((*self.key, self.index))).count().filter("count > 1")

    def check(self) -> SeriesFrame:
        """Raise if a (key, index) occurs twice."""
        if not self.duplicates().isEmpty():
            raise ValueError("key and index do not identify each row")
        return self

    def _with(self, df: DataFrame) -> Any:
        if not {*self.key, self.index} <= set(df.columns):
            return df
        return replace(self, df=df)

    def filter(self, on: Column | str) -> Any:
        return self._with(self.df.filter(on))

    def select(self, *cols: Column | str) -> Any:
        return self._with(self.df.select(*cols))

    def with_columns(self, cols: Mapping[str, Column]) -> Any:
        return self._with(self.df.withColumns(dict(cols)))

    def transmute(self, cols: Mapping[str, Column]) -> Any:
        """Keys, index and the columns given; a response or distribution that isn't among them is lost."""
        return self._with(self.df.select(*quoted([*self.key, self.index]), *[c.alias(k) for k, c in cols.items()]))

    def group_by(self, *keys: str) -> Any:
        """The same table with groups, which :meth:`summarise` keeps; no names end the grouping."""
        if unknown := {*keys} - {*self.df.columns}:
            raise ValueError(f"no columns: {sorted(unknown)}")
        return replace(self, groups=tuple(keys))

    def summarise(self, **aggs: Column) -> Any:
        """One row for each group and index.  Forecasts stay forecasts while their distribution is among the columns."""
        by = list(dict.fromkeys([*self.groups, self.index]))
        out = self.df.groupBy(*quoted(by)).agg(*[c.alias(k) for k, c in aggs.items()])
        return replace(self, key=self.groups, groups=())._with(out)

    def longer(self, columns: Sequence[str], names_to: str = "response", values_to: str = "value") -> SeriesFrame:
        """Several measured columns as series of one, told apart by ``names_to``, which ends the key."""
        ids = [c for c in self.df.columns if c not in columns]
        numbers = self.df.select(*quoted(ids), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
        return SeriesFrame(numbers.unpivot(quoted(ids), quoted(columns), names_to, values_to), (*self.key, names_to), self.index, self.interval)

    def renamed(self, names: Mapping[str, str]) -> Any:
        out = self.df.withColumnsRenamed(dict(names))
        return replace(self, df=out, key=tuple(names.get(k, k) for k in self.key), index=names.get(self.index, self.index))

    def semi_join(self, keys: DataFrame) -> Any:
        """Rows of the series that ``keys`` has."""
        return self._with(join_on(self.df, keys, self.key, "left_semi"))

    def key_data(self) -> DataFrame:
        return self.df.select(*quoted(self.key)).distinct()

    def last(self) -> DataFrame:
        """The latest row of each series."""
        row = F.max_by(F.struct(*quoted(self.measured)), F.col(self.index))
        return self.df.groupBy(*quoted(self.key)).agg(F.max(self.index).alias(self.index), row.alias("__r")).select(*self.key, self.index, "__r.*")

    def union(self, *others: SeriesFrame) -> Any:
        """Rows of all tables by name; roles must agree."""
        out = self.df
        for o in others:
            if (o.key, o.index) != (self.key, self.index):
                raise ValueError("tables with other keys or another index")
            out = out.unionByName(o.df, allowMissingColumns=True)
        return replace(self, df=out)

    def dotted(self) -> DataFrame:
        """Output names with a leading dot, for display."""
        return self.df.withColumnsRenamed({c: f".{c}" for c in ("model", "mean", "fitted", "resid", "innov", "rep", "type") if c in self.df.columns})


@dataclass(frozen=True)
class ModelTable:
    """One row for each key and model: (key, model, state, ok, error); what a model is stands in ``defs``."""

    df: DataFrame
    key: tuple[str, ...]
    index: str
    interval: Interval
    response: str
    defs: Mapping[str, Any]
    data: SeriesFrame | None = None
    plans: Mapping[str, Any] = field(default_factory=dict)

    @property
    def models(self) -> list[str]:
        return [*self.defs, *self.plans]

    def select(self, *models: str) -> ModelTable:
        """Some of the models."""
        keep = {m: self.defs[m] for m in models if m in self.defs}
        plans = {m: self.plans[m] for m in models if m in self.plans}
        if not keep and not plans:
            raise ValueError("a model table needs a model")
        needed = {*keep, *(p.source for p in plans.values() if hasattr(p, "source"))}
        return replace(self, df=self.df.filter(F.col("model").isin(*needed)), defs={m: self.defs[m] for m in self.defs if m in needed}, plans=plans)

    def filter(self, on: Column | str) -> ModelTable:
        return replace(self, df=self.df.filter(on))

    def union(self, other: ModelTable) -> ModelTable:
        if other.response != self.response or other.key != self.key:
            raise ValueError("model tables of another response or key")
        return replace(self, df=self.df.unionByName(other.df), defs={**self.defs, **other.defs}, plans={**self.plans, **other.plans})

    def formatted(self) -> DataFrame:
        """One row a series and a column a model, each cell with the model's class in angle brackets, as tables are shown."""
        cell = F.lit("<NULL model>")
        for name, d in self.defs.items():
            cell = F.when((F.col("model") == name) & F.col("ok"), F.lit(f"<{type(d).__name__}>")).otherwise(cell)
        return self.df.groupBy(*quoted(self.key)).pivot("model", [*self.defs]).agg(F.first(cell))

    def null_models(self) -> DataFrame:
        """The series and models that could not be fitted."""
        return self.df.filter(~F.col("ok")).select(*self.key, "model", "error")

    def errors(self) -> DataFrame:
        """How often each error occurred, by model."""
        return self.df.filter(~F.col("ok")).groupBy("model", "error").count()

    def __repr__(self) -> str:
        return f"ModelTable(key={list(self.key)}, models={self.models}, response={self.response})"


@dataclass(frozen=True)
class ForecastTable(SeriesFrame):
    """Series with a distribution: mu, sigma on the transformed scale, or sample; mean on the response scale.

    ``inverse`` gives for each model the function back to the response scale.
    """

    response: str = "value"
    inverse: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)

    def _with(self, df: DataFrame) -> Any:
        cols = set(df.columns)
        if {"mu", "sigma"} <= cols:
            return super()._with(df)
        if {*self.key, self.index} <= cols:
            return SeriesFrame(df, self.key, self.index, self.interval)
        return df

    def back(self, x: Column) -> Column:
        """``x`` on the response scale, by model."""
        out = x
        for model, inv in self.inverse.items():
            out = F.when(F.col("model") == model, inv(x)).otherwise(out)
        return out

    def union(self, *others: ForecastTable) -> ForecastTable:
        if any(o.response != self.response for o in others):
            raise ValueError("forecasts of another response")
        joined = super().union(*others)
        return replace(joined, inverse={k: v for t in (self, *others) for k, v in t.inverse.items()})


@dataclass(frozen=True)
class DecompTable(SeriesFrame):
    """Components of a series. aliases: named expressions over them; the response's own puts it together again."""

    response: str = "value"
    method: str = ""
    seasons: Mapping[str, float] = field(default_factory=dict)
    aliases: Mapping[str, str] = field(default_factory=dict)

    def alias(self, name: str) -> Column:
        return F.expr(self.aliases[name])

    def _with(self, df: DataFrame) -> Any:
        out = super()._with(df)
        if isinstance(out, DecompTable) and self.response not in df.columns:
            return SeriesFrame(df, self.key, self.index, self.interval)
        return out

    def union(self, *others: DecompTable) -> DecompTable:
        if any(o.response != self.response for o in others):
            raise ValueError("decompositions of another response")
        aliases: dict[str, str] = {}
        for t in (self, *others):
            for k, v in t.aliases.items():  # of two, the one over more variables
                if k not in aliases or len(set(v.split())) > len(set(aliases[k].split())):
                    aliases[k] = v
        methods = " & ".join(dict.fromkeys(t.method for t in (self, *others)))
        return replace(super().union(*others), method=methods, seasons={k: v for t in (self, *others) for k, v in t.seasons.items()}, aliases=aliases)


def scenarios(names_to: str = "scenario", **tables: SeriesFrame) -> SeriesFrame:
    """Several futures in one table, told apart by ``names_to``, which leads the key."""
    first = next(iter(tables.values()))
    parts = [t.df.withColumn(names_to, F.lit(name)) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return replace(first, df=out, key=(names_to, *first.key))


def response_vars(table: Any) -> tuple[str, ...]:
    return (table.response,)


def distribution_vars(table: Any) -> tuple[str, ...]:
    """The columns that hold the distribution of forecasts."""
    return tuple(c for c in ("mu", "sigma", "sample") if c in table.df.columns)


def is_forecasts(x: Any) -> bool:
    return isinstance(x, ForecastTable)


def is_models(x: Any) -> bool:
    return isinstance(x, ModelTable)


def is_decomposition(x: Any) -> bool:
    return isinstance(x, DecompTable)


def is_null_model(table: ModelTable) -> DataFrame:
    """(key, model, null): which fitted models are null models."""
    return table.df.select(*quoted(table.key), "model", (~F.col("ok")).alias("null"))


def _distinct(df: DataFrame, by: Sequence[str], what: str) -> None:
    if missing := {*by} - {*df.columns}:
        raise ValueError(f"{what} lack columns: {sorted(missing)}")
    if not df.groupBy(*quoted(by)).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what}: {', '.join(by)} do not identify each row")


def as_models(df: DataFrame, key: Sequence[str], index: str, interval: Interval, response: str, defs: Mapping[str, Any], data: SeriesFrame | None = None) -> ModelTable:
    """A model table of stored rows (key, model, n, last, state, ok, error); each series has a model once, and all models are defined."""
    _distinct(df, [*key, "model"], "models")
    if missing := {"n", "last", "state", "ok", "error"} - {*df.columns}:
        raise ValueError(f"models lack columns: {sorted(missing)}")
    if not df.filter(~F.col("model").isin(*defs)).isEmpty():
        raise ValueError("models without a definition")
    return ModelTable(df, tuple(key), index, interval, response, dict(defs), data)


def as_decomposition(df: DataFrame, key: Sequence[str], index: str, interval: Interval, response: str, aliases: Mapping[str, str], method: str = "", seasons: Mapping[str, float] | None = None) -> DecompTable:
    """A decomposition of stored rows; (key, index) identify them and every alias can be worked out from the columns."""
    _distinct(df, [*key, index], "components")
    if response not in aliases:
        raise ValueError("it takes an expression for the response")
    df.select(*[F.expr(e).alias(k) for k, e in aliases.items()])
    return DecompTable(df, tuple(key), index, interval, response, method, dict(seasons or {}), dict(aliases))
