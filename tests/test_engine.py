"""Small hand-made cases of the series engine."""

import ast
import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import measures as ms
from seriesloom.functions.calendar import common_periods, get_frequencies
from seriesloom.functions.regressors import fourier
from seriesloom.functions.stats import box_cox, inv_box_cox, normal_cdf, sample_quantile
from seriesloom.functions.transform import Transformation
from seriesloom.meta import Interval, SeriesFrame, as_decomposition, as_models, distribution_vars, is_decomposition, is_forecasts, is_models, response_vars
from seriesloom.operators import accuracy as acc
from seriesloom.operators import hierarchy as hi
from seriesloom.operators import reconcile as rec
from seriesloom.plans import lifecycle as lc
from seriesloom.plans import models as M
from seriesloom.streaming.update import seasonal_state, seasonal_sums, stream


def series(spark, values, key="a", n=1):
    rows = [(f"{key}{k}", dt.date(2024, 1, 1) + dt.timedelta(days=i), None if v is None else float(v + k)) for k in range(n) for i, v in enumerate(values)]
    return SeriesFrame(spark.createDataFrame(rows, "k string, day date, y double"), ("k",), "day")


@pytest.mark.parametrize(
    "spec,sets",
    [("a / b", [(), ("a",), ("a", "b")]), ("a * b", [(), ("a",), ("b",), ("a", "b")]), ("a + b - 1", [("a",), ("b",)]), ("a * (b / c)", [(), ("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")])],
)
def test_structural_formula(spec, sets):
    assert hi.parse_spec(spec) == sets


def test_missing_key_is_not_aggregated(spark):
    df = spark.createDataFrame([("p", "q", 1, 1.0), ("p", None, 1, 2.0)], "a string, b string, t int, v double")
    out = hi.aggregate_key(SeriesFrame(df, ("a", "b"), "t", Interval("unit")), "a / b", partial={"v": "sum"}).df
    got = {(r.a, r.a__agg, r.b, r.b__agg): r.sum_v for r in out.collect()}
    assert got == {(None, True, None, True): 3.0, ("p", False, None, True): 3.0, ("p", False, "q", False): 1.0, ("p", False, None, False): 2.0}


@pytest.mark.parametrize(
    "t", [Transformation().log(), Transformation().log(10), Transformation().log1p(), Transformation().sqrt(), Transformation() ** 3, 2 ** (Transformation() / 10), 1 / Transformation(), 5 - Transformation(), (3 * (Transformation() + 1)).log().exp(), Transformation().box_cox(0.3), Transformation().expm1().log2()]
)
def test_transformations_go_back(spark, t):
    df = spark.createDataFrame([(0.5,), (1.0,), (4.0,)], "x double")
    for r in df.select("x", t.inverse(t(F.col("x"))).alias("y"), t.inverted()(t(F.col("x"))).alias("z")).collect():
        assert r.y == pytest.approx(r.x) and r.z == pytest.approx(r.x)


def test_no_inverse():
    with pytest.raises(ValueError):
        M.parse_response("sin(y) ~ 1")
    with pytest.raises(ValueError):
        M.parse_response("a / b ~ 1")
    assert M.parse_response("resp(a) * 2 ~ 1")[0] == "a"


def test_bias_adjustment_agrees_with_differences(spark):
    df = spark.createDataFrame([(1.0, 0.3)], "m double, s double")
    exact = df.select(Transformation().log().mean(F.col("m"), F.col("s"))).first()[0]
    assert exact == pytest.approx(math.exp(1) * (1 + 0.09 / 2))


@pytest.mark.parametrize("lam,x,want", [(0.0, 4.0, math.log(4)), (0.5, 4.0, 2.0), (-1.0, -1.0, None), (-1.0, 4.0, 0.75), (1.0, -1.0, -2.0)])
def test_box_cox_edges(spark, lam, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(box_cox(F.col("x"), lam).alias("b"), inv_box_cox(box_cox(F.col("x"), lam), lam).alias("i")).first()
    assert got.b == (None if want is None else pytest.approx(want))
    if want is not None:
        assert got.i == pytest.approx(x)


def test_normal_cdf_and_quantiles(spark):
    df = spark.createDataFrame([(z,) for z in (-8.0, -3.0, 0.0, 1.0, 5.0, 9.0)], "z double")
    for r in df.select("z", normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=1e-12)
    assert spark.range(1).select(sample_quantile(F.array(F.lit(4.0), F.lit(1.0), F.lit(2.0)), 0.75)).first()[0] == 3.0


def test_periods():
    assert common_periods(Interval("month")) == {"year": 12.0}
    assert get_frequencies(None, Interval("day")) == [7.0]
    assert get_frequencies("1 day", Interval("hour")) == [24.0]
    assert get_frequencies(None, Interval("day", 0)) == [1.0]
    with pytest.raises(ValueError):
        fourier(F.lit(1), 7, 4)


def test_short_series_get_null_models(spark):
    t = lc.model(series(spark, [1, 2, 3]), a=M.MEAN("y"), b=M.SNAIVE("y", 7))
    assert [(r.model, r.error) for r in t.null_models().collect()] == [("b", "too few values")]
    fc = {(r.model, r.h): r.mean for r in lc.forecast(t, 2).df.collect()}
    assert fc[("a", 1)] == 2.0 and fc[("b", 1)] is None


def test_nan_is_missing(spark):
    assert lc.forecast(lc.model(series(spark, [1, float("nan"), 3]), a=M.MEAN("y")), 1).df.first().mean == 2.0


def test_combination_does_not_depend_on_order(spark):
    s = series(spark, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7], n=2)
    a, b = M.NAIVE("y"), M.MEAN("y")
    one, two = (lc.forecast(lc.model(s, c=(x + y) / 2), 3).df.orderBy("k", "h").collect() for x, y in ((a, b), (b, a)))
    for p, q in zip(one, two, strict=True):
        assert p.mu == pytest.approx(q.mu) and p.sigma == pytest.approx(q.sigma)
    with pytest.raises(TypeError):
        a * b


def test_combination_of_one_model_with_itself(spark):
    s = series(spark, [3, 1, 4, 1, 5, 9])
    got = lc.forecast(lc.model(s, m=M.NAIVE("y"), c=(M.NAIVE("y") + M.NAIVE("y")) / 2), 2).df.orderBy("h").collect()
    by = {(r.model, r.h): (r.mu, r.sigma) for r in got}
    assert by[("c", 2)] == pytest.approx(by[("m", 2)])


def test_crps_of_samples(spark):
    y, x = 1.3, sorted([0.2, 1.0, 1.9, 4.0])
    df = spark.createDataFrame([(y, x)], "y double, sample array<double>")
    i = ms.Inputs(F.lit(0.0), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("sample"), F.lit(1.0), F.lit(1.0), lambda c: c)
    want = np.mean(np.abs(np.array(x) - y)) - np.abs(np.subtract.outer(x, x)).mean() / 2
    assert df.select(ms.CRPS(i)).first()[0] == pytest.approx(want)


def test_zero_actuals(spark):
    s = series(spark, [1, 2, 3, 0])
    fc = lc.forecast(lc.model(s.filter(F.col("day") < "2024-01-04"), m=M.NAIVE("y")), 1)
    got = acc.accuracy(fc, s, {"MPE": ms.MPE, "MAAPE": ms.MAAPE, "ACF1": ms.ACF1}, period=1).first()
    assert got.MPE is None and got.MAAPE == pytest.approx(math.pi / 2) and got.ACF1 is None


def test_python_measures_that_fail_are_null(spark):
    s = series(spark, [1, 2, 3, 4])
    fc = lc.forecast(lc.model(s.filter(F.col("day") < "2024-01-04"), m=M.NAIVE("y")), 1)
    got = acc.accuracy(fc, s, {"ME": ms.ME}, period=1, python={"bad": lambda e, y: 1 / 0, "worst": lambda e, y: max(e)}).first()
    assert got.bad is None and got.worst == 1.0


def _two_level(spark, n=24):
    rng = np.random.default_rng(5)
    rows = [(k, dt.date(2020 + m // 12, m % 12 + 1, 1), float(20 + 5 * rng.standard_normal())) for k in ("x", "y", "z") for m in range(n)]
    base = SeriesFrame(spark.createDataFrame(rows, "k string, month date, v double"), ("k",), "month", Interval("month"))
    out = hi.aggregate_key(base, "k", partial={"v": "sum"})
    return SeriesFrame(out.df.withColumnRenamed("sum_v", "v"), out.key, out.index, out.interval)


@pytest.mark.parametrize("method", ["ols", "wls_struct", "wls_var", "mint_cov", "mint_shrink"])
def test_min_trace_is_coherent(spark, method):
    # residuals of a linear model add up exactly, and their covariance is singular
    base = M.DRIFT("log(v)") if method == "mint_cov" else M.NAIVE("v")
    t = rec.reconcile(lc.model(_two_level(spark), b=base, c=M.MEAN("v")), r=rec.min_trace("b", method))
    rows = lc.forecast(t, 2).df.filter("model = 'r' and h = 1").collect()
    total = next(r.mean for r in rows if r.k__agg)
    assert total == pytest.approx(sum(r.mean for r in rows if not r.k__agg))
    assert all((r.sigma is None) == (method == "mint_cov") for r in rows)


def test_weights_as_published(spark):
    """Shrinkage and covariance by numpy over the residual matrix, with incomplete rows."""
    frame = _two_level(spark)
    holes = SeriesFrame(frame.df.withColumn("v", F.when((F.col("k") != "x") | F.col("k").isNull() | (F.month("month") != 5), F.col("v"))), frame.key, frame.index, frame.interval)
    table = lc.model(holes, b=M.SNAIVE("v", 12))
    rows = lc.augment(table).df.withColumn("node", hi.node_key(["k"])).collect()
    names, months = sorted({r.node for r in rows}), sorted({r.month for r in rows})
    res = np.full((len(months), len(names)), np.nan)
    for r in rows:
        res[months.index(r.month), names.index(r.node)] = np.nan if r.resid is None else r.resid
    n, full = len(res), res[~np.isnan(res).any(1)]
    assert 3 < len(full) < n - 12
    cov, tar = full.T @ full / n, np.diag(np.nansum(res**2, 0) / n)
    xs = full / np.sqrt(np.diag(cov))
    v = ((xs**2).T @ xs**2 - (xs.T @ xs) ** 2 / n) / (n * (n - 1))
    np.fill_diagonal(v, 0)
    d = (cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))) - np.eye(4)) ** 2
    lam = min(max(v.sum() / d.sum(), 0), 1)
    s = np.array([[1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    assert np.allclose(rec.weights(table, "b", names, s, "mint_cov"), cov)
    assert np.allclose(rec.weights(table, "b", names, s, "wls_var"), np.diag(np.diag(cov)))
    assert 0 < lam <= 1 and np.allclose(rec.weights(table, "b", names, s, "mint_shrink"), lam * tar + (1 - lam) * cov)


@pytest.mark.parametrize("method", ["ols", "wls_struct", "wls_var"])
def test_levels_agree_with_matrices(spark, monkeypatch, method):
    """A nested hierarchy of three levels, reconciled level by level and by the projection matrix; forecasts that don't add up."""
    rng = np.random.default_rng(8)
    rows = [(a, f"{a}{b}", dt.date(2020 + m // 12, m % 12 + 1, 1), float(20 + 5 * rng.standard_normal())) for a in "xyz" for b in range(ord(a) - 118) for m in range(20)]
    base = SeriesFrame(spark.createDataFrame(rows, "a string, b string, month date, v double"), ("a", "b"), "month", Interval("month"))
    out = hi.aggregate_key(base, "a / b", partial={"v": "sum"})
    t = lc.model(SeriesFrame(out.df.withColumnRenamed("sum_v", "v"), out.key, out.index, out.interval), b=M.DRIFT("log(v)"))
    fc = lc.forecast(t, 2)
    fc = replace(fc, df=fc.df.withColumn("sigma", 1 + F.pmod(F.hash("a", "b"), F.lit(5))), inverse={})
    key = ["a", "b", "h"]
    one = sorted((str([r[k] for k in key]), r.mu, r.sigma) for r in rec._min_trace(t, fc, "b", method).collect())
    monkeypatch.setattr(rec, "_levels", lambda *args, **kw: [])
    two = sorted((str([r[k] for k in key]), r.mu, r.sigma) for r in rec._min_trace(t, fc, "b", method).collect())
    assert len(one) == 26 and [x[0] for x in one] == [x[0] for x in two]
    assert np.allclose([x[1:] for x in one], [x[1:] for x in two])


def test_leaves_of_a_hierarchy_that_is_not_balanced(spark):
    df = spark.createDataFrame([("A", False, "x", False), ("A", False, "y", False), ("A", False, None, True), ("B", False, None, True), (None, True, None, True)], "a string, a__agg boolean, b string, b__agg boolean")
    frame = SeriesFrame(df.withColumns({"t": F.lit(1), "v": F.lit(1.0)}), ("a", "a__agg", "b", "b__agg"), "t", Interval("unit"))
    assert {r.node for r in hi.leaves(frame).collect()} == {"=A|=x", "=A|=y", "=B|*"}
    assert {(r.node, r.leaf) for r in hi.coherent_smat(frame).collect()} == {("*|*", x) for x in ("=A|=x", "=A|=y", "=B|*")} | {("=A|*", "=A|=x"), ("=A|*", "=A|=y"), ("=A|=x", "=A|=x"), ("=A|=y", "=A|=y"), ("=B|*", "=B|*")}
    assert "NestedLoop" not in hi.coherent_smat(frame)._jdf.queryExecution().executedPlan().toString()


def test_projection_forms_agree():
    s = np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    a = np.random.default_rng(1).standard_normal((5, 5))
    w = a @ a.T + np.eye(5)
    inv = np.linalg.inv(w)
    assert np.allclose(rec.projection(s, w, [2, 3, 4]), s @ np.linalg.solve(s.T @ inv @ s, s.T @ inv))
    with pytest.raises(ValueError):
        rec.projection(s, np.zeros((5, 5)), [2, 3, 4])


def test_updates_in_batches_and_streams(spark, tmp_path):
    s = series(spark, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3], n=2)
    for k, cut in enumerate(("2024-01-04", "2024-01-11")):
        part = s.df.filter((F.col("day") < cut) & (F.col("day") >= ("2024-01-01" if not k else "2024-01-04")))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(s.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = seasonal_state(live, ["k"], "day", "y", 3).writeStream.outputMode("update").format("memory").queryName("seasons").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = {r.k: r.means for r in spark.table("seasons").orderBy("n").collect()}
    for r in seasonal_sums(s.df, ["k"], "day", "y", 3).collect():
        assert last[r.k][r.season] == pytest.approx(r["mean"])


def test_generated_paths_agree_between_runs(spark):
    t = lc.model(series(spark, [3, 1, 4, 1, 5, 9, 2, 6]), a=M.NAIVE("y"))
    one, two = (lc.generate(t, 4, times=3, seed=9).df.orderBy("rep", "h").collect() for _ in range(2))
    assert one == two and len(one) == 12


class _Level:
    def __init__(self, y):
        self.y = list(y)

    def forecast(self, h):
        return [self.y[-1]] * h, [1.0] * h

    def fitted(self):
        return [None, *self.y[:-1]]

    def components(self):
        return {"level": [v - 1 for v in self.y], "season": [1.0] * len(self.y)}

    def update(self, y):
        return _Level([*self.y, *y])

    def irf(self, h):
        return [1 / (k + 1) for k in range(h)]

    def simulate(self, h, rng):
        return self.y[-1] + rng.integers(0, 2, h)


def test_hooks_of_python_models(spark):
    own = M.new_model_class("LEVEL", lambda y, period, index: _Level(y))
    s = series(spark, [3, 1, 4, 1, 5, 9], n=2)
    t = lc.model(s, a=own("y"))
    parts = lc.components(t).df.collect()
    assert len(parts) == 12 and all(r.level == r.y - 1 and r.season == 1 and r.remainder == 0 for r in parts)
    assert {(r.k, r.h): r.response for r in lc.irf(t, 3).collect()} == {(f"a{k}", h): 1 / h for k in range(2) for h in (1, 2, 3)}
    one, two = (lc.generate(t, 3, times=2, seed=4).df.orderBy("k", "rep", "h").collect() for _ in range(2))
    assert one == two and {r.sim - (9 if r.k == "a0" else 10) for r in one} <= {0.0, 1.0}
    new = SeriesFrame(spark.createDataFrame([("a0", dt.date(2024, 1, 7), 2.0)], "k string, day date, y double"), ("k",), "day")
    after = stream(t, new)
    assert {r.k: (r.mean, r.day) for r in lc.forecast(after, 1).df.collect()} == {"a0": (2.0, dt.date(2024, 1, 8)), "a1": (10.0, dt.date(2024, 1, 7))}
    assert {r.day: r.fitted for r in lc.fitted(t, 2).df.filter("k = 'a0'").collect()} == {dt.date(2024, 1, d): v for d, v in ((1, None), (2, None), (3, 3.0), (4, 1.0), (5, 4.0), (6, 1.0))}


def test_paths_of_combinations_and_new_data(spark):
    s = series(spark, [3, 1, 4, 1, 5, 9, 2, 6])
    t = lc.model(s, a=M.NAIVE("y"), b=M.MEAN("y"), c=2 * M.NAIVE("y") - M.MEAN("y"))
    new = SeriesFrame(spark.createDataFrame([("a0", dt.date(2024, 2, d)) for d in (1, 2, 3)], "k string, day date"), ("k",), "day")
    paths = lc.generate(t, times=2, seed=3, new_data=new).df.collect()
    assert {r.model for r in paths} == {"a", "b", "c"} and len(paths) == 18 and {r.day for r in paths} == {dt.date(2024, 2, d) for d in (1, 2, 3)}
    draws = [r.sim for r in lc.generate(lc.model(s, b=M.MEAN("y")), 1, times=4000, seed=5).df.collect()]
    fc = lc.forecast(lc.model(s, b=M.MEAN("y")), 1).df.first()
    assert np.mean(draws) == pytest.approx(fc.mu, abs=4 * fc.sigma / 60) and np.std(draws) == pytest.approx(fc.sigma, rel=0.05)
    walk = [r.sim for r in lc.generate(lc.model(s, a=M.NAIVE("y")), 4, times=4000, seed=6).df.filter("h = 4").collect()]
    end = lc.forecast(lc.model(s, a=M.NAIVE("y")), 4).df.filter("h = 4").first()
    assert np.mean(walk) == pytest.approx(end.mu, abs=4 * end.sigma / 60) and np.std(walk) == pytest.approx(end.sigma, rel=0.05)
    left = {float(r.resid) for r in lc.residuals(lc.model(s, a=M.NAIVE("y"))).df.filter("resid is not null").collect()}
    centred = {round(x - np.mean(list(left)), 6) for x in left} | {round(x - sum([-2, 3, -3, 4, 4, -7, 4]) / 7, 6) for x in left}
    steps = lc.generate(lc.model(s, a=M.NAIVE("y")), 1, times=50, seed=7, bootstrap=True).df.collect()
    assert {round(r.sim - 6, 6) for r in steps} <= centred


def test_sample_percentiles(spark):
    y, x = 1.3, [0.2, 4.0, 1.0, 1.9]
    df = spark.createDataFrame([(y, x)], "y double, sample array<double>")
    i = ms.Inputs(F.lit(0.0), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("sample"), F.lit(1.0), F.lit(1.0), lambda c: c)
    p = np.arange(1, 100) / 100
    q = np.quantile(x, p)
    want = 2 * np.mean(np.where(y >= q, p * (y - q), (1 - p) * (q - y)))
    assert df.select(ms.percentile_score(i)).first()[0] == pytest.approx(want)


def test_constructors_check_their_rows(spark):
    s = series(spark, [3, 1, 4, 1, 5])
    t = lc.model(s, a=M.NAIVE("y"))
    again = as_models(t.df, t.key, t.index, t.interval, "y", {"a": M.NAIVE("y")}, s)
    assert lc.forecast(again, 1).df.first().mean == 5.0 and is_models(again) and not is_forecasts(again)
    for rows, defs in ((t.df.union(t.df), {"a": M.NAIVE("y")}), (t.df, {"b": M.NAIVE("y")}), (t.df.drop("state"), {"a": M.NAIVE("y")})):
        with pytest.raises(ValueError):
            as_models(rows, t.key, t.index, t.interval, "y", defs)
    parts = s.df.withColumns({"level": F.col("y") - 1, "season": F.lit(1.0)})
    d = as_decomposition(parts, ("k",), "day", s.interval, "y", {"y": "level + season"})
    assert is_decomposition(d) and d.df.filter(d.alias("y") != F.col("y")).count() == 0
    with pytest.raises(ValueError):
        as_decomposition(parts.union(parts), ("k",), "day", s.interval, "y", {"y": "level + season"})


def test_verbs_keep_or_lose_the_distribution(spark):
    fc = lc.forecast(lc.model(series(spark, [3, 1, 4, 1, 5], n=2), a=M.NAIVE("y")), 2)
    assert is_forecasts(fc.transmute({"mu": F.col("mu"), "sigma": F.col("sigma")})) and not is_forecasts(fc.transmute({"m": F.col("mean")}))
    grouped = fc.group_by("model")
    total = grouped.summarise(mu=F.sum("mu"), sigma=F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))))
    assert is_forecasts(total) and total.key == ("model",) and total.df.count() == 2
    assert not is_forecasts(grouped.summarise(n=F.count("*"))) and grouped.group_by().groups == ()
    assert response_vars(fc) == ("y",) and distribution_vars(fc) == ("mu", "sigma")


def test_formulas_are_completed(spark):
    s = series(spark, [3, 1, 4, 1, 5, 9, 2, 6]).with_columns({"x": F.dayofmonth("day") * F.dayofmonth("day")})
    one, two = (lc.forecast(lc.model(s, m=M.TSLM(f)), new_data=SeriesFrame(s.df.select("k", "day", "x"), s.key, s.index)).df.orderBy("h").collect() for f in ("~ .", "y ~ x"))
    assert one == two and lc.model(s, m=M.NAIVE("")).response == "y"
    with pytest.raises(ValueError):
        SeriesFrame(s.df.select("k", "day"), s.key, s.index).guess_response()


def test_several_responses(spark):
    s = series(spark, [3, 1, 4, 1, 5]).with_columns({"z": F.col("y") * 2})
    t = lc.model(s, a=M.NAIVE("vars(y, z)"))
    assert {r.response: r.mean for r in lc.forecast(t, 1).df.collect()} == {"y": 5.0, "z": 10.0}
    with pytest.raises(ValueError):
        lc.model(s, a=M.NAIVE("vars(y, z)"), b=M.NAIVE("y"))
    names = M.traverse(ast.parse("log(y + 1)", mode="eval").body, lambda n: {getattr(n, "id", None)} - {None}, lambda n, kids: set().union(*kids))
    assert names == {"log", "y"}
