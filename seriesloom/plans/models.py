"""Model definitions: what is aggregated to fit them, and their fitted values and forecasts as columns.

A fitted model is a ``state`` struct of one schema for all classes, so any
number of models over any number of series is one table, and the models with a
closed form are fitted by one aggregation together.
"""

from __future__ import annotations

import ast
import pickle
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions import regressors
from seriesloom.functions.stats import divide
from seriesloom.functions.transform import IDENTITY, Transformation

STATE = "struct<a:double,b:double,s2:double,center:double,spread:double,tail:array<double>,scale:array<double>,blob:binary>"


def state(**parts: Column) -> Column:
    """A state from the parts that a model has."""
    kinds = dict(x.split(":", 1) for x in STATE[7:-1].split(","))
    return F.struct(*[(parts[k].cast(t) if k in parts else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()])


@dataclass(frozen=True)
class ModelDef:
    """``formula`` is ``response ~ terms``; the response may be transformed, such as ``log(value)``."""

    formula: str
    period: float | None = None
    #: Rows that it takes to fit the model.
    least: int = 1

    @property
    def response(self) -> str:
        return parse_response(self.formula)[0]

    @property
    def transformation(self) -> Transformation:
        return parse_response(self.formula)[1]

    @property
    def rhs(self) -> str:
        return self.formula.partition("~")[2].strip()

    def __add__(self, other: Any) -> Any:
        from .combination import Combination

        return Combination.of(self) + other

    __radd__ = __add__

    def __sub__(self, other: Any) -> Any:
        return self + -1 * other

    def __neg__(self) -> Any:
        return -1 * self

    def __mul__(self, w: float) -> Any:
        from .combination import Combination

        return Combination.of(self) * w

    __rmul__ = __mul__

    def __truediv__(self, w: float) -> Any:
        from .combination import Combination

        return Combination.of(self) / w


class ClosedForm(ModelDef):
    """A model that one aggregation fits. ``m`` is the seasonal lag in rows."""

    def lags(self, m: int) -> list[int]:
        return []

    def fit(self, y: Column, t: Column, lag: Callable[[int], Column], last_rank: Column, m: int) -> Column:
        raise NotImplementedError

    def fitted(self, s: Column, t: Column, lag: Callable[[int], Column], m: int) -> Column:
        raise NotImplementedError

    def forecast(self, s: Column, n: Column, h: Column, m: int) -> tuple[Column, Column]:
        raise NotImplementedError

    def tidy(self, m: int) -> dict[str, Callable[[Column], Column]]:
        """Names of coefficients and where they are in the state."""
        return {}


def _tail(y: Column, t: Column, last_rank: Column, m: int) -> Column:
    """The last m values in order; nothing else of the series is gathered."""
    rows = F.array_sort(F.collect_list(F.when(last_rank <= m, F.struct(t.alias("t"), y.alias("y")))))
    return F.transform(rows, lambda r: r["y"])


class MEAN(ClosedForm):
    """The mean of all values."""

    def fit(self, y, t, lag, last_rank, m):
        return state(a=F.avg(y), s2=F.var_samp(y), spread=F.count(y))

    def fitted(self, s, t, lag, m):
        return s["a"]

    def forecast(self, s, n, h, m):
        return s["a"], F.sqrt(s["s2"] * (1 + 1 / n))

    def tidy(self, m):
        return {"mean": lambda s: s["a"]}


class NAIVE(ClosedForm):
    """The last value."""

    def lags(self, m):
        return [1]

    def fit(self, y, t, lag, last_rank, m):
        return state(tail=_tail(y, t, last_rank, 1), s2=F.avg((y - lag(1)) * (y - lag(1))), spread=F.count(y - lag(1)))

    def fitted(self, s, t, lag, m):
        return lag(1)

    def forecast(self, s, n, h, m):
        return F.get(s["tail"], F.lit(0)), F.sqrt(s["s2"] * h)


class DRIFT(ClosedForm):
    """A random walk with the mean change."""

    def lags(self, m):
        return [1]

    def fit(self, y, t, lag, last_rank, m):
        d = y - lag(1)
        return state(tail=_tail(y, t, last_rank, 1), b=F.avg(d), s2=F.var_samp(d), spread=F.count(d))

    def fitted(self, s, t, lag, m):
        return lag(1) + s["b"]

    def forecast(self, s, n, h, m):
        return F.get(s["tail"], F.lit(0)) + s["b"] * h, F.sqrt(s["s2"] * h * (1 + divide(h, n - 1)))

    def tidy(self, m):
        return {"drift": lambda s: s["b"]}


class SNAIVE(ClosedForm):
    """The value one season ago."""

    def lags(self, m):
        return [m]

    def fit(self, y, t, lag, last_rank, m):
        return state(tail=_tail(y, t, last_rank, m), s2=F.avg((y - lag(m)) * (y - lag(m))), spread=F.count(y - lag(m)))

    def fitted(self, s, t, lag, m):
        return lag(m)

    def forecast(self, s, n, h, m):
        return F.get(s["tail"], ((h - 1) % m).cast("int")), F.sqrt(s["s2"] * (F.floor((h - 1) / m) + 1))


class TREND(ClosedForm):
    """A straight line over the row number."""

    def fit(self, y, t, lag, last_rank, m):
        x = F.when(y.isNotNull(), t.cast("double"))
        b, n = F.regr_slope(y, x), F.count(y)
        sse = F.regr_syy(y, x) - b * F.regr_sxy(y, x)
        return state(a=F.regr_intercept(y, x), b=b, s2=divide(F.greatest(sse, F.lit(0.0)), n - 2), center=F.avg(x), spread=F.regr_sxx(y, x))

    def fitted(self, s, t, lag, m):
        return s["a"] + s["b"] * t

    def forecast(self, s, n, h, m):
        off = n + h - s["center"]
        return s["a"] + s["b"] * (n + h), F.sqrt(s["s2"] * (1 + 1 / n + off * off / s["spread"]))

    def tidy(self, m):
        return {"intercept": lambda s: s["a"], "trend": lambda s: s["b"]}


class NULL(ClosedForm):
    """No model: everything is missing."""

    def fit(self, y, t, lag, last_rank, m):
        return state()

    def fitted(self, s, t, lag, m):
        return F.lit(None).cast("double")

    def forecast(self, s, n, h, m):
        return F.lit(None).cast("double"), F.lit(None).cast("double")


class SMEAN(ModelDef):
    """The mean of each season; fitted by season first, so that long series stay spread."""

    def tidy(self, m):
        return {f"season_{k + 1}": (lambda s, k=k: F.get(s["tail"], F.lit(k))) for k in range(m)}

    def fitted(self, s, t, lag, m):
        return F.get(s["tail"], ((t - 1) % m).cast("int"))

    def forecast(self, s, n, h, m):
        at = ((n + h - 1) % m).cast("int")
        return F.get(s["tail"], at), F.get(s["scale"], at)


@dataclass(frozen=True)
class TSLM(ModelDef):
    """Linear regression on trend(), season(p), fourier(p, K), lag(x, n) and columns; normal equations by series."""

    def terms(self, t: Column, step: Column, period: float) -> dict[str, Column]:
        """Design columns; ``t`` counts rows from 1, ``step`` index units since the epoch."""
        out: dict[str, Column] = {}
        parts, intercept = parse_rhs(self.rhs or "trend()")
        if intercept:
            out["intercept"] = F.lit(1.0)
        for name, args in parts:
            if name == "trend":
                out |= regressors.trend(t, tuple(args))
            elif name == "season":
                out |= regressors.season(step, args[0] if args else period)
            elif name == "fourier":
                out |= regressors.fourier(t, args[0] if len(args) > 1 else period, int(args[-1]))
            elif name == "lag":
                out[f"lag_{args[0]}_{args[1] if len(args) > 1 else 1}"] = F.col(f"`__lag_{args[0]}_{args[1] if len(args) > 1 else 1}`")
            else:
                out[name] = F.col(f"`{name}`").cast("double")
        return out

    def lagged(self) -> list[tuple[str, int]]:
        """Columns whose earlier values are regressors; a forecast goes on from the training rows."""
        return [(a[0], int(a[1]) if len(a) > 1 else 1) for n, a in parse_rhs(self.rhs or "trend()")[0] if n == "lag"]

    def columns(self) -> list[str]:
        known = {"trend", "season", "fourier", "lag"}
        return [n for n, _ in parse_rhs(self.rhs or "trend()")[0] if n not in known] + [x for x, _ in self.lagged()]


class Fit(Protocol):
    """What a Python model class gives: arrays in, arrays out, on the transformed scale."""

    def forecast(self, h: int) -> tuple[Sequence[float], Sequence[float]]: ...

    def fitted(self) -> Sequence[float]: ...


@dataclass(frozen=True)
class PythonModel(ModelDef):
    """A model class of the user's: ``train(y, period, index)`` returns an object with the methods of :class:`Fit`.

    Optional are ``components()`` (level and season, one value a row), ``update(y)`` (the fit after more values; else it
    is trained again), ``irf(h)`` and ``simulate(h, rng)`` (a path; else draws around the forecasts).
    """

    train: Callable[..., Any] = field(default=None)
    options: Mapping[str, Any] = field(default_factory=dict)


def new_model_class(name: str, train: Callable[..., Any], specials: Mapping[str, Callable[..., Any]] | None = None, check: Callable[[Any], None] | None = None) -> Callable[..., PythonModel]:
    """A class of models by its ``train`` function; ``specials`` evaluates the terms of the formula for it."""

    def define(formula: str, period: float | None = None, **options: Any) -> PythonModel:
        given = dict(options)
        if specials:
            for term, args in parse_rhs(formula.partition("~")[2].strip())[0]:
                if term not in specials:
                    raise ValueError(f"{name} has no special {term}")
                given[term] = specials[term](*args)

        def run(y: Any, **more: Any) -> Any:
            if check:
                check(y)
            return train(y, **more, **given)

        return PythonModel(formula, period, 1, run, given)

    define.__name__ = name
    return define


new_model_definition = new_model_class


def dump(model: Any) -> bytes:
    from pyspark import cloudpickle

    return cloudpickle.dumps(model)


def load(blob: bytes) -> Any:
    return pickle.loads(blob)


def parse_rhs(text: str) -> tuple[list[tuple[str, list[Any]]], bool]:
    """Terms of the right side as (name, arguments), and whether there is an intercept."""
    out: list[tuple[str, list[Any]]] = []
    intercept = True

    def walk(node: ast.expr, sign: int = 1) -> None:
        nonlocal intercept
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add | ast.Sub):
            walk(node.left, sign)
            walk(node.right, sign if isinstance(node.op, ast.Add) else -sign)
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            walk(node.operand, -sign)
        elif isinstance(node, ast.Constant) and node.value in (0, 1):
            intercept = node.value == 1 and sign > 0
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            args = [a.id if isinstance(a, ast.Name) else ast.literal_eval(a) for a in [*node.args, *[k.value for k in node.keywords]]]
            if node.func.id == "xreg":
                out.extend((a, []) for a in args)
            else:
                out.append((node.func.id, args))
        elif isinstance(node, ast.Name):
            out.append((node.id, []))
        else:
            raise ValueError(f"not a term of a formula: {ast.unparse(node)}")

    if text:
        walk(ast.parse(text.replace("~", ""), mode="eval").body)
    return out, intercept


def parse_response(formula: str) -> tuple[str, Transformation]:
    """The response column and its transformation; ``resp(x)`` says which of several names is the response."""
    node = ast.parse(formula.partition("~")[0].strip(), mode="eval").body
    names = [n.id for n in ast.walk(node) if isinstance(n, ast.Name) and not any(isinstance(c, ast.Call) and c.func is n for c in ast.walk(node))]
    marked = [c.args[0].id for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and c.func.id == "resp"]
    if len(marked) > 1:
        raise ValueError("resp() may be used once")
    response = marked[0] if marked else names[0] if len(set(names)) == 1 else None
    if response is None:
        raise ValueError(f"the response of {formula!r} is not clear: mark it by resp()")

    def build(n: ast.expr) -> Transformation | float:
        if isinstance(n, ast.Name):
            if n.id != response:
                raise ValueError(f"{n.id} is not a constant")
            return IDENTITY
        if isinstance(n, ast.Constant):
            return float(n.value)
        if isinstance(n, ast.UnaryOp):
            x = build(n.operand)
            return -x if isinstance(n.op, ast.USub) else x
        if isinstance(n, ast.BinOp):
            a, b = build(n.left), build(n.right)
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.Pow: lambda: a**b}
            return ops[type(n.op)]()
        if isinstance(n, ast.Call):
            first, *rest = [build(a) for a in n.args]
            if n.func.id == "resp":
                return first
            if n.func.id in ("log", "log10", "log2", "log1p", "expm1", "exp", "sqrt", "box_cox", "inv_box_cox"):
                return getattr(first, n.func.id)(*rest)
        raise ValueError(f"no inverse is known for {ast.unparse(n)}")

    got = build(node)
    return response, got if isinstance(got, Transformation) else IDENTITY


def parse_responses(formula: str) -> tuple[str, ...]:
    """The names in ``vars(a, b)`` on the left of a formula; none for other formulas."""
    node = ast.parse(formula.partition("~")[0].strip(), mode="eval").body
    if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "vars"):
        return ()
    if not node.args or not all(isinstance(a, ast.Name) for a in node.args):
        raise ValueError("vars() takes names of columns")
    return tuple(a.id for a in node.args)


def traverse(node: ast.AST, leaf: Callable[[ast.AST], Any], join: Callable[[ast.AST, list[Any]], Any]) -> Any:
    """Fold a formula's tree from its leaves: ``leaf`` of names and constants, ``join`` of a node and what its parts gave."""
    kids = [k for k in ast.iter_child_nodes(node) if isinstance(k, ast.expr | ast.keyword)]
    return join(node, [traverse(k, leaf, join) for k in kids]) if kids else leaf(node)


def model_lhs(d: ModelDef) -> str:
    return d.formula.partition("~")[0].strip()


def model_rhs(d: ModelDef) -> str:
    return d.rhs


def with_period(d: ModelDef, period: float) -> ModelDef:
    return replace(d, period=period)
