"""Forecasts of a hierarchy made to add up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.meta import ForecastTable, ModelTable, SeriesFrame, quoted
from seriesloom.plans.lifecycle import augment
from seriesloom.sources.saved import saved

from .hierarchy import MOST_NODES, base_keys, coherent_smat, flag, leaves, node_key, nodes


@dataclass(frozen=True)
class Reconcile:
    """A further model: ``source`` reconciled by ``how`` with ``options``."""

    source: str
    how: str
    options: tuple[tuple[str, Any], ...] = ()

    def apply(self, name: str, table: ModelTable, fc: ForecastTable) -> ForecastTable:
        base = replace(fc, df=fc.df.filter(F.col("model") == self.source))
        if self.source in fc.inverse:  # not normal on the response scale: only the means are reconciled
            base = replace(base, df=base.df.withColumn("sigma", F.lit(None).cast("double")))
        got = _METHODS[self.how](table, base, self.source, **dict(self.options))
        return replace(fc, df=fc.df.unionByName(got.withColumn("model", F.lit(name)), allowMissingColumns=True))


def reconcile(table: ModelTable, **plans: Reconcile) -> ModelTable:
    """Add reconciled models; the work is done when forecasts are made."""
    return replace(table, plans={**table.plans, **plans})


def bottom_up(source: str) -> Reconcile:
    return Reconcile(source, "bottom_up")


def top_down(source: str, method: str = "forecast_proportions") -> Reconcile:
    return Reconcile(source, "top_down", (("method", method),))


def middle_out(source: str, split: int | str = 1) -> Reconcile:
    return Reconcile(source, "middle_out", (("split", split),))


def min_trace(source: str, method: str = "wls_var") -> Reconcile:
    return Reconcile(source, "min_trace", (("method", method),))


def _frame(table: ModelTable) -> SeriesFrame:
    """The node table as a frame, whatever its size; nodes are those that have models."""
    return SeriesFrame(table.df.select(*quoted(table.key), F.lit(0).alias(table.index)).distinct(), table.key, table.index, table.interval)


def _nodes(table: ModelTable) -> DataFrame:
    """The nodes, saved: the relations between them are worked out from this table."""
    return saved(nodes(_frame(table)), "nodes")


def _cols(table: ModelTable, fc: ForecastTable) -> list[str]:
    return [table.index] + (["h"] if "h" in fc.df.columns else [])


def _shape(table: ModelTable, fc: ForecastTable, df: DataFrame, n: DataFrame) -> DataFrame:
    """(node, index, h, mu, sigma) with the node's keys again."""
    return df.join(n, "node").select(*quoted([*table.key, *_cols(table, fc)]), "mu", "sigma", F.col("mu").alias("mean"))


def _bottom_up(table: ModelTable, fc: ForecastTable, source: str) -> DataFrame:
    """Leaf forecasts summed; variances add up. Only leaves' forecasts are read."""
    keys = base_keys(_frame(table))
    n = _nodes(table)
    s = coherent_smat(_frame(table), all_nodes=n)
    rows = fc.df.withColumn("leaf", node_key(keys)).select("leaf", *_cols(table, fc), F.col("mean").alias("m"), "sigma")
    got = rows.join(s, "leaf").groupBy("node", *_cols(table, fc)).agg(F.sum("m").alias("mu"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("sigma"))
    return _shape(table, fc, got, n)


def _levels(table: ModelTable, n: DataFrame, strict: bool = True) -> list[str]:
    """Keys from the top of a strict hierarchy down; if it isn't strict, none or, with ``strict``, an error."""
    keys = base_keys(_frame(table))
    open_ = [F.sum((~F.col(f"`{flag(k)}`")).cast("long")).alias(k) for k in keys]
    first = n.agg(*open_).first()
    order = sorted(keys, key=lambda k: -(first[k] or 0))
    sets = {tuple(sorted(k for k in keys if not r[flag(k)])) for r in n.select(*[F.col(f"`{flag(k)}`") for k in keys]).distinct().collect()}
    if sets != {tuple(sorted(order[:d])) for d in range(len(order) + 1)}:
        if not strict:
            return []
        raise ValueError("top-down and middle-out reconciliation take a strictly nested hierarchy")
    return order


def _depth(keys: Sequence[str]) -> Column:
    return sum(((~F.col(f"`{flag(k)}`")).cast("int") for k in keys), F.lit(0))


def _parent(keys: Sequence[str], order: Sequence[str], depth: int) -> Column:
    """Text of the ancestor at ``depth``, with its keys in the hierarchy's own order."""
    kept = {k for k in order[:depth]}
    parts = []
    for k in keys:
        own = F.when(F.col(f"`{flag(k)}`"), F.lit("*")).otherwise(F.coalesce(F.concat(F.lit("="), F.regexp_replace(F.col(f"`{k}`").cast("string"), r"([|\\])", r"\\$1")), F.lit("?")))
        parts.append(own if k in kept else F.lit("*"))
    return F.concat_ws("|", *parts)


def _split_down(table: ModelTable, fc: ForecastTable, order: list[str], start: int) -> DataFrame:
    """(node, index, h, mu, sigma, depth) from depth ``start`` down by forecast proportions.

    A child's share of its parent is its forecast over its siblings' sum, at each
    horizon; shares are multiplied level by level (as many steps as levels).
    """
    keys, at = base_keys(_frame(table)), _cols(table, fc)
    rows = fc.df.withColumns({"node": node_key(keys), "depth": _depth(keys)})
    out = level = rows.filter(F.col("depth") == start).select("node", *at, F.col("mean").alias("mu"), "sigma", "depth")
    for d in range(start + 1, len(order) + 1):
        w = Window.partitionBy("parent", *at)
        share = F.when(F.sum("mean").over(w) != 0, F.col("mean") / F.sum("mean").over(w))
        kids = rows.filter(F.col("depth") == d).withColumn("parent", _parent(keys, order, d - 1)).withColumn("share", share)
        up = level.select(F.col("node").alias("parent"), *at, F.col("mu").alias("m"), F.col("sigma").alias("s"))
        level = kids.select("node", "parent", *at, "share", "depth").join(up, ["parent", *at]).select("node", *at, (F.col("share") * F.col("m")).alias("mu"), (F.abs("share") * F.col("s")).alias("sigma"), "depth")
        out = out.unionByName(level)
    return out


def _top_down(table: ModelTable, fc: ForecastTable, source: str, method: str) -> DataFrame:
    """The top forecast shared out: by forecasts, by mean historical proportions or by proportions of historical means."""
    n = _nodes(table)
    order = _levels(table, n)
    if method == "forecast_proportions":
        return _shape(table, fc, _split_down(table, fc, order, 0), n)
    if method not in ("average_proportions", "proportion_averages"):
        raise ValueError(f"no such method: {method}")
    keys, at = base_keys(_frame(table)), _cols(table, fc)
    y = F.col(f"`{table.response}`").cast("double")
    rows = table.data.df.select(node_key(keys).alias("node"), _depth(keys).alias("depth"), F.col(f"`{table.index}`").alias("__t"), y.alias("y"))
    top = rows.filter("depth = 0").select("__t", F.col("y").alias("top"))
    both = rows.join(top, "__t", "left")
    bad = F.count(F.when(F.col("y").isNull() | F.isnan("y") | F.col("top").isNull(), 1))
    p = F.avg(F.when(F.col("top") != 0, F.col("y") / F.col("top"))) if method == "average_proportions" else F.when(F.avg("top") != 0, F.avg("y") / F.avg("top"))
    shares = both.groupBy("node").agg(F.when(bad == 0, p).alias("p")).join(leaves(_frame(table), n).select("node"), "node")
    s = coherent_smat(_frame(table), all_nodes=n)
    total = s.join(shares.withColumnRenamed("node", "leaf"), "leaf").groupBy("node").agg(F.sum("p").alias("p"))
    tops = fc.df.filter(_depth(keys) == 0).select(*at, F.col("mean").alias("m"), F.col("sigma").alias("s"))
    got = total.crossJoin(F.broadcast(tops)).select("node", *at, (F.col("p") * F.col("m")).alias("mu"), (F.abs("p") * F.col("s")).alias("sigma"))  # tops: one row a horizon
    return _shape(table, fc, got, n)


def _middle_out(table: ModelTable, fc: ForecastTable, source: str, split: int | str) -> DataFrame:
    """Shared out below the split level, summed above it."""
    n = _nodes(table)
    order, at = _levels(table, n), _cols(table, fc)
    depth = order.index(split) + 1 if isinstance(split, str) else int(split)
    down = _split_down(table, fc, order, depth)
    keyed = down.filter(F.col("depth") == depth).join(n, "node")
    keys = base_keys(_frame(table))
    for d in range(depth):
        up = keyed.groupBy(_parent(keys, order, d).alias("node"), *quoted(at)).agg(F.sum("mu").alias("mu"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("sigma")).withColumn("depth", F.lit(d))
        down = down.unionByName(up)
    return _shape(table, fc, down, n)


def residual_matrix(table: ModelTable, source: str, names: list[str]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(sum of products over complete times, sum of squares of products, times, own sums of squares), n x n on the driver.

    The products are summed in Spark by time: one row of n residuals a time, each
    task adds up its own, and only n x n sums reach the driver.
    """
    n = len(names)
    if n > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes: use wls_struct or ols")
    keys, number = base_keys(_frame(table)), {k: i for i, k in enumerate(names)}
    res = augment(replace(table, plans={})).df.filter(F.col("model") == source).select(node_key(keys).alias("node"), F.col(f"`{table.index}`").alias("__t"), F.col("resid").alias("r"))
    rows = res.groupBy("__t").agg(F.collect_list(F.struct("node", "r")).alias("all"))

    def add(batches):
        s, sq, rows_, full = np.zeros((n, n)), np.zeros((n, n)), 0, 0
        own = np.zeros((3, n))
        for pdf in batches:
            for all_ in pdf["all"]:
                x = np.full(n, np.nan)
                for e in all_:
                    if e["r"] is not None and e["node"] in number:
                        x[number[e["node"]]] = e["r"]
                rows_ += 1
                ok = ~np.isnan(x)
                own[0, ok] += 1
                own[1, ok] += x[ok]
                own[2, ok] += x[ok] ** 2
                if ok.all():
                    full += 1
                    s += np.outer(x, x)
                    sq += np.outer(x * x, x * x)
        flat = np.concatenate([s.ravel(), sq.ravel(), own.ravel(), [rows_, full]])
        yield pd.DataFrame({"k": np.arange(flat.size), "v": flat})

    got = rows.select("all").mapInPandas(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(2 * n * n + 3 * n + 2)
    flat[got["k"].to_numpy()] = got["v"].to_numpy()
    own = flat[2 * n * n : 2 * n * n + 3 * n].reshape(3, n)
    return flat[: n * n].reshape(n, n), flat[n * n : 2 * n * n].reshape(n, n), int(flat[-1]), np.vstack([own, np.full(n, flat[-2])])


def weights(table: ModelTable, source: str, names: list[str], s: np.ndarray, method: str) -> np.ndarray:
    """The weight matrix W of minimum trace reconciliation.

    Covariances are sums over the times at which all nodes have residuals,
    divided by the number of all times.  Shrinkage draws them to the nodes' own
    mean squares, by the ratio of the correlations' estimated variances to their
    squared distances from the target's.
    """
    n = len(names)
    if method == "ols":
        return np.eye(n)
    if method == "wls_struct":
        return np.diag(s.sum(1))
    xx, xx2, _, own = residual_matrix(table, source, names)
    rows = int(own[3, 0])
    cov = xx / max(rows, 1)
    if method == "wls_var":
        return np.diag(np.diag(cov))
    if method == "mint_cov":
        return cov
    if method != "mint_shrink":
        raise ValueError(f"no such method: {method}")
    var = own[2] / rows
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    xs, xs2 = xx / np.outer(sd, sd), xx2 / np.outer(sd, sd) ** 2
    v = (xs2 - xs**2 / rows) / (rows * (rows - 1))
    np.fill_diagonal(v, 0)
    d = (corr - np.eye(n)) ** 2
    lam = float(np.clip(v.sum() / d.sum(), 0, 1)) if d.sum() else 1.0
    return lam * np.diag(var) + (1 - lam) * cov


def projection(s: np.ndarray, w: np.ndarray, bottom: Sequence[int]) -> np.ndarray:
    """S P for the leaves ``bottom``; in constraint form, which solves for the aggregates alone."""
    if np.linalg.eigvalsh(w).min() < 1e-8:
        raise ValueError("the covariance of the forecasts is not positive definite: use another method")
    n, up = len(s), [i for i in range(len(s)) if i not in set(bottom)]
    j = np.zeros((len(bottom), n))
    j[np.arange(len(bottom)), bottom] = 1
    if not up:
        return s @ j
    u = np.zeros((n, len(up)))
    u[up, np.arange(len(up))] = 1
    u[list(bottom)] -= s[up].T
    p = j - j @ w @ u @ np.linalg.solve(u.T @ w @ u, u.T)
    return s @ p


def _min_trace(table: ModelTable, fc: ForecastTable, source: str, method: str) -> DataFrame:
    """Least total variance among linear coherent forecasts.

    With weights for each node alone a strictly nested hierarchy of any size is
    reconciled level by level (:func:`_tree_trace`).  Otherwise the nodes'
    matrices are needed on the driver, so there may be MOST_NODES nodes at most.
    """
    keys, at = base_keys(_frame(table)), _cols(table, fc)
    n = _nodes(table)
    if method in ("ols", "wls_struct", "wls_var") and (order := _levels(table, n, strict=False)):
        return _tree_trace(table, fc, source, method, n, order)
    if n.count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    triples = coherent_smat(_frame(table), all_nodes=n).select("node", "leaf").collect()
    low = sorted({r.leaf for r in triples})
    names = sorted({r.node for r in triples})
    row, col = {k: i for i, k in enumerate(names)}, {k: i for i, k in enumerate(low)}
    s = np.zeros((len(names), len(low)))
    for r in triples:
        s[row[r.node], col[r.leaf]] = 1
    w = weights(table, source, names, s, method)
    sp = projection(s, w, [row[k] for k in low])
    d = np.sqrt(np.diag(w))
    corr = w / np.outer(d, d)
    rows = fc.df.select(node_key(keys).alias("node"), *quoted(at), F.col("mean").alias("mu"), "sigma")

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        mu, sd = np.full(len(names), np.nan), np.full(len(names), np.nan)
        k = pdf["node"].map(row).to_numpy()
        mu[k], sd[k] = pdf["mu"].to_numpy(float), pdf["sigma"].to_numpy(float)
        var = np.einsum("ij,ij->i", sp @ (corr * np.outer(sd, sd)), sp)
        out = pd.DataFrame({"node": names})
        for c in at:
            out[c] = pdf[c].iloc[0]
        out["mu"], out["sigma"] = sp @ mu, np.sqrt(np.maximum(var, 0))
        return out

    schema = T.StructType([rows.schema["node"], *[rows.schema[c] for c in at], T.StructField("mu", T.DoubleType()), T.StructField("sigma", T.DoubleType())])
    return _shape(table, fc, rows.groupBy(*quoted(at)).applyInPandas(apply, schema), n)


def _node_weights(table: ModelTable, source: str, method: str, n: DataFrame) -> DataFrame:
    """(node, w): the diagonal of W, worked out in Spark; raises if a weight is too small to divide by."""
    keys = base_keys(_frame(table))
    if method == "ols":
        return n.select("node", F.lit(1.0).alias("w"))
    if method == "wls_struct":
        return coherent_smat(_frame(table), all_nodes=n).groupBy("node").agg(F.count("*").cast("double").alias("w"))
    res = augment(replace(table, plans={})).df.filter(F.col("model") == source)
    res = saved(res.select(node_key(keys).alias("node"), F.col(f"`{table.index}`").alias("t"), F.col("resid").alias("r")), "residuals")
    times = res.groupBy("t").agg(F.count("r").alias("n"))
    all_times, nodes_ = times.count(), n.count()
    w = res.join(times.filter(F.col("n") == nodes_), "t").groupBy("node").agg((F.sum(F.col("r") * F.col("r")) / all_times).alias("w"))
    w = saved(n.select("node").join(w, "node", "left").select("node", F.coalesce("w", F.lit(0.0)).alias("w")), "weights")
    if not w.filter("w < 1e-8").isEmpty():
        raise ValueError("the covariance of the forecasts is not positive definite: use another method")
    return w


def _tree_trace(table: ModelTable, fc: ForecastTable, source: str, method: str, n: DataFrame, order: list[str]) -> DataFrame:
    """Minimum trace reconciliation of a strictly nested hierarchy with a weight w for each node, exact at any size.

    From the leaves up, a node's forecast y is weighed against the sum s of its
    children's: x = a y + (1 - a) s with a = v / (w + v), v the children's summed
    w, and its own w becomes w v / (w + v).  From the top down, what a parent's
    final value differs from s by, d, is shared out in proportion to the
    children's w.  Variances go along: forecasts of different nodes are taken as
    uncorrelated, as W has them, and g is how d above changes with x.
    """
    keys, at = base_keys(_frame(table)), _cols(table, fc)
    rows = fc.df.withColumns({"node": node_key(keys), "depth": _depth(keys)})
    up = rows.select("node", *quoted(at), "depth", *[_parent(keys, order, d).alias(f"p{d}") for d in range(len(order))], F.col("mean").alias("y"), (F.col("sigma") * F.col("sigma")).alias("y2"))
    up = saved(up.join(_node_weights(table, source, method, n), "node"), "weighed")
    levels: list[DataFrame] = []
    for d in range(len(order), -1, -1):
        own = up.filter(F.col("depth") == d)
        own = own.withColumn("parent", F.col(f"p{d - 1}") if d else F.lit("")).select("node", "parent", *quoted(at), "y", "y2", "w")
        if levels:
            kids = levels[-1].groupBy(F.col("parent").alias("node"), *quoted(at)).agg(*[F.sum(c).alias(k) for c, k in (("x", "s"), ("v", "sv"), ("x2", "s2"))])
            a = F.col("sv") / (F.col("w") + F.col("sv"))
            own = own.join(kids, ["node", *at]).withColumn("a", a)
            own = own.withColumns({"x": F.col("a") * F.col("y") + (1 - F.col("a")) * F.col("s"), "v": F.col("w") * F.col("a"), "x2": F.col("a") * F.col("a") * F.col("y2") + (1 - F.col("a")) * (1 - F.col("a")) * F.col("s2")})
        else:
            none = F.lit(None).cast("double")
            own = own.withColumns({"s": none, "sv": none, "s2": none, "a": none, "x": F.col("y"), "v": F.col("w"), "x2": F.col("y2")})
        levels.append(saved(own, "level"))
    out = None
    for d, own in enumerate(levels[::-1]):
        if d:
            above = above.select(F.col("node").alias("parent"), *quoted(at), *[F.col(c).alias(f"p_{c}") for c in ("sv", "a", "k", "g", "d", "d2")])
            own = own.join(above, ["parent", *at]).withColumn("k", F.col("v") / F.col("p_sv"))
            own = own.withColumn("g", F.col("p_k") * F.col("p_g") * (1 - F.col("p_a")) - F.col("p_a"))
            own = own.withColumns({"mu": F.col("x") + F.col("k") * F.col("p_d"), "var": F.col("x2") + F.col("k") * F.col("k") * F.col("p_d2") + 2 * F.col("k") * F.col("x2") * F.col("g")})
        else:
            own = own.withColumns({"k": F.lit(0.0), "g": F.lit(0.0), "p_d2": F.lit(0.0), "mu": F.col("x"), "var": F.col("x2")})
        cross = 2 * F.col("a") * F.col("k") * F.col("g") * (F.col("a") * F.col("y2") - (1 - F.col("a")) * F.col("s2"))
        above = own.withColumns({"d": F.col("mu") - F.col("s"), "d2": F.col("a") * F.col("a") * (F.col("y2") + F.col("s2")) + F.col("k") * F.col("k") * F.col("p_d2") + cross})
        got = own.select("node", *quoted(at), "mu", F.sqrt(F.greatest("var", F.lit(0.0))).alias("sigma"))
        out = got if out is None else out.unionByName(got)
    return _shape(table, fc, out, n)


_METHODS = {"bottom_up": _bottom_up, "top_down": _top_down, "middle_out": _middle_out, "min_trace": _min_trace}
