"""Named queries over the driver tables, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import measures as ms
from .functions.dist import from_interval, hilo, point_forecasts, quantile, unpack_hilo
from .functions.regressors import fourier, season, trend
from .functions.stats import box_cox, inv_box_cox, z_of
from .functions.transform import Transformation
from .meta import Interval, SeriesFrame, is_null_model, scenarios
from .operators import accuracy as acc
from .operators import features as feat
from .operators import hierarchy as hi
from .operators import reconcile as rec
from .operators import temporal as tm
from .plans import lifecycle as lc
from .plans import models as M
from .plans.combination import combination_ensemble, combination_weighted
from .plans.decomposition import decompose, decomposition_model
from .sources.saved import saved
from .sources.tables import as_series, events_daily, orders_monthly, read_table
from .streaming.update import stream

#: The events cover 2024-01-01 to 2024-01-30: the last seven days are the test set.
SPLIT, H = "2024-01-24", 7
_all: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def r(c: Column | str, digits: int = 4) -> Column:
    """Rounded, and zero without a sign."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r(c) for c in cols})


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _all[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all.items() if s}


# ---------------------------------------------------------------- hierarchies

ORDERS = """o AS (
  SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _sets(*sets: str) -> str:
    return "GROUPING SETS (" + ", ".join("(month" + (", " + s if s else "") + ")" for s in sets) + ")"


def _agg_sql(keys: tuple[str, ...], sets: tuple[str, ...], value: str) -> str:
    cols = ", ".join(f"{k}, grouping({k}) = 1 AS {k}__agg" for k in keys)
    return f"WITH {ORDERS} SELECT month, {cols}, {value} FROM o GROUP BY {_sets(*sets)}"


_SUMS = "round(sum(price), 2) AS sum_price"


def _aggkey(spark: SparkSession, sf: str, spec: str) -> DataFrame:
    out = hi.aggregate_key(orders_monthly(spark, sf), spec, partial={"price": "sum"}).df
    return out.withColumn("sum_price", F.round("sum_price", 2))


@query(_agg_sql(("region", "nation"), ("", "region", "region, nation"), _SUMS))
def aggkey_nested(spark, sf):
    return _aggkey(spark, sf, "region / nation")


@query(_agg_sql(("region", "segment"), ("", "region", "segment", "region, segment"), _SUMS))
def aggkey_crossed(spark, sf):
    return _aggkey(spark, sf, "region * segment")


@query(_agg_sql(("region", "nation", "segment"), ("", "segment", "region", "region, nation", "segment, region", "segment, region, nation"), _SUMS))
def aggkey_mixed(spark, sf):
    return _aggkey(spark, sf, "segment * (region / nation)")


@query(_agg_sql(("region", "nation"), ("region", "region, nation"), _SUMS))
def aggkey_no_total(spark, sf):
    return _aggkey(spark, sf, "region / nation - 1")


@query(_agg_sql(("region", "nation"), ("", "region", "region, nation"), "round(median(price), 3) AS mid, count(*) AS n"))
def aggkey_holistic(spark, sf):
    out = hi.aggregate_key(orders_monthly(spark, sf), "region / nation", {"mid": F.median("price"), "n": F.count("*")}).df
    return out.withColumn("mid", F.round("mid", 3))


@query(
    f"""WITH {ORDERS} SELECT DISTINCT CASE WHEN grouping(region) = 1 THEN '<aggregated>' ELSE region END AS region_text,
  CASE WHEN grouping(nation) = 1 THEN '<aggregated>' ELSE nation END AS nation_text, grouping(region) = 1 AS top, coalesce(region, '') = 'ASIA' AS asia
  FROM o GROUP BY GROUPING SETS ((), (region), (region, nation))"""
)
def agg_vector(spark, sf):
    out = hi.aggregate_key(orders_monthly(spark, sf), "region / nation", partial={"price": "sum"}).df
    return out.select(hi.format_key(out, "region").alias("region_text"), hi.format_key(out, "nation").alias("nation_text"), hi.is_aggregated(out, "region").alias("top"), hi.agg_equal("region", "ASIA", out).alias("asia")).distinct()


def _tree(spark: SparkSession, sf: str) -> SeriesFrame:
    """Monthly totals of all nodes of region / nation; zero-filled, so that every node has every month."""
    cells = orders_monthly(spark, sf)
    base = cells.df.groupBy("region", "nation", "month").agg(F.round(F.sum("price"), 2).alias("price"))
    whole = tm.fill_gaps(SeriesFrame(base, ("region", "nation"), "month", Interval("month")), full=True)
    whole = whole.with_columns({"price": F.coalesce("price", F.lit(0.0))})
    out = hi.aggregate_key(whole, "region / nation", partial={"price": "sum"})
    return saved(replace(out, df=out.df.withColumn("y", F.round("sum_price", 2)).drop("sum_price")), "tree")


TREE = f"""{ORDERS}, cells AS (SELECT region, nation, month, round(sum(price), 2) AS price FROM o GROUP BY ALL),
span AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM cells),
whole AS (SELECT k.region, k.nation, span.month, coalesce(price, 0) AS price FROM (SELECT DISTINCT region, nation FROM cells) k CROSS JOIN span LEFT JOIN cells USING (region, nation, month)),
tree AS (SELECT region, grouping(region) = 1 AS ra, nation, grouping(nation) = 1 AS na, month, round(sum(price), 2) AS y FROM whole GROUP BY {_sets("", "region", "region, nation")}),
named AS (SELECT *, CASE WHEN ra THEN '*' ELSE '=' || region END || '|' || CASE WHEN na THEN '*' ELSE '=' || nation END AS node FROM tree)"""
_SMAT = "SELECT DISTINCT n.node, l.node AS leaf FROM named n JOIN named l ON NOT l.na AND (n.ra OR n.region = l.region) AND (n.na OR n.nation = l.nation)"


@query(f"WITH {TREE} SELECT node, leaf, 1 AS value FROM ({_SMAT})")
def smat_edges(spark, sf):
    return hi.coherent_smat(_tree(spark, sf))


@query(f"WITH {TREE}, s AS ({_SMAT}) SELECT node AS \"constraint\", node, 1 AS value FROM s WHERE node <> leaf GROUP BY node UNION ALL SELECT node, leaf, -1 FROM s WHERE node <> leaf")
def cmat_edges(spark, sf):
    return hi.coherent_cmat(_tree(spark, sf))


@query(f"WITH {TREE} SELECT node AS \"constraint\", month, 0.0::DOUBLE AS gap FROM named WHERE na")
def coherence_gaps(spark, sf):
    return hi.incoherence(_tree(spark, sf), "y").withColumn("gap", r("gap", 1))


# ---------------------------------------------------------------- calendar

EV = "ev AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS value, count(*) AS n FROM events GROUP BY ALL)"


def _weekly(shift: str) -> str:
    return f"""WITH {EV}, e AS (SELECT *, min(day) OVER () AS lo, max(day) OVER () AS hi FROM ev), f AS (SELECT *, CAST(date_trunc('week', lo) AS DATE) AS b0 FROM e),
g AS (SELECT *, CAST({shift} AS INT) AS s FROM f), h AS (SELECT *, b0 + s + 7 * CAST(floor((day - b0 - s) / 7.0) AS INT) AS bin FROM g)
SELECT event_type, bin AS day, round(sum(value), 2) AS total FROM h {{where}} GROUP BY 1, 2 HAVING count(*) = 7"""


def _weeks(spark: SparkSession, sf: str, offset: str | None) -> DataFrame:
    return tm.aggregate_index(events_daily(spark, sf), "1 week", {"total": F.round(F.sum("value"), 2)}, offset).df


@query(_weekly("0").format(where=""))
def aggindex_weekly(spark, sf):
    return _weeks(spark, sf, None)


@query(_weekly("lo - b0").format(where=""))
def aggindex_weekly_start(spark, sf):
    return _weeks(spark, sf, "start")


@query(_weekly("(hi - b0) % 7").format(where="WHERE day < hi"))
def aggindex_weekly_end(spark, sf):
    return _weeks(spark, sf, "end")


@query(
    """WITH d AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, CAST(date_trunc('quarter', day) AS DATE) AS day, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1, 2
HAVING count(*) = date_trunc('quarter', min(day))::DATE + INTERVAL 3 MONTH - date_trunc('quarter', min(day))::DATE"""
    .replace("date_trunc('quarter', min(day))::DATE + INTERVAL 3 MONTH - date_trunc('quarter', min(day))::DATE", "date_diff('day', date_trunc('quarter', min(day)), date_trunc('quarter', min(day)) + INTERVAL 3 MONTH)")
)
def aggindex_quarterly_complete(spark, sf):
    return tm.aggregate_index(_shipped(spark, sf), "quarter", {"n": F.sum("n")}, None).df


def _shipped(spark: SparkSession, sf: str) -> SeriesFrame:
    d = read_table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return SeriesFrame(d, ("l_returnflag",), "day")


@query(
    """WITH d AS (SELECT DISTINCT l_returnflag, CAST(l_shipdate AS DATE) AS day FROM lineitem), s AS (SELECT l_returnflag, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1)
SELECT l_returnflag, g.day, d.day IS NULL AS gap FROM (SELECT l_returnflag, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s) g LEFT JOIN d USING (l_returnflag, day)"""
)
def fill_gaps(spark, sf):
    return tm.fill_gaps(_shipped(spark, sf)).df.select("l_returnflag", "day", F.col("n").isNull().alias("gap"))


@query(
    """WITH d AS (SELECT DISTINCT l_returnflag, CAST(l_shipdate AS DATE) AS before FROM lineitem), e AS (SELECT *, lead(before) OVER (PARTITION BY l_returnflag ORDER BY before) AS after FROM d)
SELECT *, after - before - 1 AS n FROM e WHERE after - before > 1"""
)
def gap_runs(spark, sf):
    return tm.gaps(_shipped(spark, sf))


@query(f"WITH {EV} SELECT event_type, max(day) + h AS day, h FROM ev, (SELECT CAST(unnest(range(1, 15)) AS INT) AS h) GROUP BY event_type, h")
def future_dates(spark, sf):
    return tm.future(events_daily(spark, sf)).df


# ---------------------------------------------------------------- models

TRAIN = f"""{EV}, tr AS (SELECT *, row_number() OVER w AS t, count(*) OVER (PARTITION BY event_type) AS size, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS back,
  lag(value) OVER w AS l1, lag(value, 7) OVER w AS l7 FROM ev WHERE day < DATE '{SPLIT}' WINDOW w AS (PARTITION BY event_type ORDER BY day)),
hs AS (SELECT CAST(unnest(range(1, {H + 1})) AS INT) AS h)"""


def _train(spark: SparkSession, sf: str) -> SeriesFrame:
    return events_daily(spark, sf).filter(F.col("day") < SPLIT)


def _fc(spark: SparkSession, sf: str, d: M.ModelDef) -> DataFrame:
    return rounded(lc.forecast(lc.model(_train(spark, sf), m=d), H).df, "mu", "sigma", "mean")


def _fc_sql(stats: str, mu: str, sd: str, more: str = "") -> str:
    return f"""WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, count(*) AS n, {stats} FROM tr GROUP BY 1){more}
SELECT event_type, last + h AS day, h, 'm' AS model, round({mu}, 4) + 0.0 AS mu, round({sd}, 4) + 0.0 AS sigma, round({mu}, 4) + 0.0 AS mean FROM st, hs"""


_LAST = "arg_max(value, day) AS y"
MEAN_SQL = ("avg(value) AS a, var_samp(value) AS s2", "a", "sqrt(s2 * (1 + 1.0 / n))")
NAIVE_SQL = (f"{_LAST}, avg((value - l1) ** 2) AS s2", "y", "sqrt(s2 * h)")
DRIFT_SQL = (f"{_LAST}, avg(value - l1) AS b, var_samp(value - l1) AS s2", "y + b * h", "sqrt(s2 * h * (1 + h / (n - 1.0)))")
SNAIVE_SQL = ("list(value ORDER BY day)[-7:] AS tail, avg((value - l7) ** 2) AS s2", "tail[(h - 1) % 7 + 1]", "sqrt(s2 * ((h - 1) // 7 + 1))")
TREND_SQL = ("regr_slope(value, t) AS b, regr_intercept(value, t) AS a, regr_avgx(value, t) AS c, regr_sxx(value, t) AS sxx, (regr_syy(value, t) - regr_slope(value, t) * regr_sxy(value, t)) / (count(*) - 2) AS s2", "a + b * (n + h)", "sqrt(s2 * (1 + 1.0 / n + (n + h - c) ** 2 / sxx))")


@query(_fc_sql(*MEAN_SQL))
def fc_mean(spark, sf):
    return _fc(spark, sf, M.MEAN("value"))


@query(_fc_sql(*NAIVE_SQL))
def fc_naive(spark, sf):
    return _fc(spark, sf, M.NAIVE("value"))


@query(_fc_sql(*DRIFT_SQL))
def fc_drift(spark, sf):
    return _fc(spark, sf, M.DRIFT("value"))


@query(_fc_sql(*SNAIVE_SQL))
def fc_snaive(spark, sf):
    return _fc(spark, sf, M.SNAIVE("value", 7))


@query(_fc_sql(*TREND_SQL))
def fc_trend(spark, sf):
    return _fc(spark, sf, M.TREND("value"))


@query(
    f"""WITH {TRAIN}, se AS (SELECT event_type, (t - 1) % 7 AS s, avg(value) AS m, stddev_samp(value) AS sd FROM tr GROUP BY ALL),
st AS (SELECT event_type, max(day) AS last, count(*) AS n FROM tr GROUP BY 1)
SELECT event_type, last + h AS day, h, 'm' AS model, round(m, 4) AS mu, round(sd, 4) AS sigma, round(m, 4) AS mean FROM st JOIN hs ON true JOIN se USING (event_type) WHERE s = (n + h - 1) % 7"""
)
def fc_smean(spark, sf):
    return _fc(spark, sf, M.SMEAN("value", 7))


@query(
    f"""WITH {TRAIN}, se AS (SELECT event_type, (day - DATE '1970-01-01') % 7 AS s, avg(value) AS m, count(*) AS k, sum(value * value) - count(*) * avg(value) ** 2 AS ss FROM tr GROUP BY ALL),
st AS (SELECT event_type, max(day) AS last, count(*) AS n FROM tr GROUP BY 1), q AS (SELECT event_type, sum(ss) AS ss FROM se GROUP BY 1)
SELECT event_type, last + h AS day, h, 'm' AS model, round(m, 4) AS mu, round(sqrt(q.ss / (n - 7) * (1 + 1.0 / k)), 4) AS sigma, round(m, 4) AS mean
FROM st JOIN hs ON true JOIN q USING (event_type) JOIN se USING (event_type) WHERE s = (last + h - DATE '1970-01-01') % 7"""
)
def fc_tslm_season(spark, sf):
    return _fc(spark, sf, M.TSLM("value ~ season(7)", 7))


@query(_fc_sql(*TREND_SQL))
def fc_tslm_trend(spark, sf):
    return _fc(spark, sf, M.TSLM("value ~ trend()"))


@query(
    f"""WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, count(*) AS n, ln(arg_max(value, day)) AS y, avg(ln(value / l1)) AS b, var_samp(ln(value / l1)) AS s2 FROM tr GROUP BY 1),
f AS (SELECT event_type, last + h AS day, h, y + b * h AS mu, sqrt(s2 * h * (1 + h / (n - 1.0))) AS sd FROM st, hs)
SELECT event_type, day, h, 'm' AS model, round(mu, 4) AS mu, round(sd, 4) AS sigma, round(exp(mu) * (1 + sd * sd / 2), 4) AS mean FROM f"""
)
def fc_log_bias_adjusted(spark, sf):
    return _fc(spark, sf, M.DRIFT("log(value)"))


@query(
    f"""WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, arg_max(value, day) AS y, avg((value - l1) ** 2) AS s2 FROM tr GROUP BY 1)
SELECT s.scenario, event_type, last + h AS day, s.x, h, 'm' AS model, round(y, 4) AS mu, round(sqrt(s2 * h), 4) AS sigma, round(y, 4) AS mean
FROM st, hs, (VALUES ('high', 2), ('low', 1)) s(scenario, x)"""
)
def fc_scenarios(spark, sf):
    t = _train(spark, sf)
    new = replace(tm.future(t, H), df=tm.future(t, H).df.drop("h"))
    both = scenarios(low=new.with_columns({"x": F.lit(1)}), high=new.with_columns({"x": F.lit(2)}))
    return rounded(lc.forecast(lc.model(t, m=M.NAIVE("value")), new_data=both).df, "mu", "sigma", "mean")


@query(
    f"""WITH {TRAIN} SELECT event_type, 'm' AS model, day, value, l7 AS fitted, round(value - l7, 4) + 0.0 AS resid, round(value - l7, 4) + 0.0 AS innov FROM tr"""
)
def augment_snaive(spark, sf):
    return rounded(lc.augment(lc.model(_train(spark, sf), m=M.SNAIVE("value", 7))).df, "resid", "innov")


@query(
    f"""WITH {TRAIN}, f AS (SELECT event_type, day, avg(value) OVER w AS mean, lag(value, 2) OVER v AS naive, lag(value, 7) OVER v AS snaive FROM tr
  WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), v AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, model, day, round(fitted, 6) AS fitted FROM (SELECT event_type, day, unnest(['mean', 'naive', 'snaive']) AS model, unnest([mean, naive, snaive]) AS fitted FROM f)"""
)
def hfitted(spark, sf):
    mt = lc.model(_train(spark, sf), mean=M.MEAN("value"), naive=M.NAIVE("value"), snaive=M.SNAIVE("value", 7))
    return lc.fitted(mt, 2).df.withColumn("fitted", r("fitted", 6))


@query(f"WITH {TRAIN} SELECT event_type, 'm' AS model, count(*) AS n, round(avg((value - l7) ** 2), 4) AS sigma2, true AS ok FROM tr GROUP BY 1")
def glance_snaive(spark, sf):
    return rounded(lc.glance(lc.model(_train(spark, sf), m=M.SNAIVE("value", 7))), "sigma2")


@query(
    f"""WITH {TRAIN}, c AS (SELECT event_type, avg(value) AS m, regr_intercept(value, t) AS a, regr_slope(value, t) AS b FROM tr GROUP BY 1)
SELECT event_type, model, term, round(x, 4) + 0.0 AS estimate FROM (SELECT event_type, unnest(['mean', 'trend', 'trend']) AS model, unnest(['mean', 'intercept', 'trend']) AS term, unnest([m, a, b]) AS x FROM c)"""
)
def tidy_models(spark, sf):
    return rounded(lc.tidy(lc.model(_train(spark, sf), mean=M.MEAN("value"), trend=M.TREND("value"))), "estimate")


@query(f"WITH {TRAIN} SELECT event_type, 'long' AS model, 'too few values' AS error FROM tr GROUP BY 1")
def null_models(spark, sf):
    return lc.model(_train(spark, sf), naive=M.NAIVE("value"), long=M.SNAIVE("value", 100)).null_models()


@query(
    f"""WITH {EV}, t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS t FROM ev WHERE day < DATE '{SPLIT}'),
h AS (SELECT event_type, day, CASE WHEN t % 5 <> 2 THEN value END AS value, n FROM t), m AS (SELECT event_type, avg(value) AS m FROM h GROUP BY 1)
SELECT event_type, day, round(coalesce(value, m), 4) AS value, n FROM h JOIN m USING (event_type)"""
)
def interp_mean(spark, sf):
    t = _train(spark, sf)
    holes = t.with_columns({"value": F.when(F.row_number().over(t.window()) % 5 != 2, F.col("value"))})
    return rounded(lc.interpolate(lc.model(holes, m=M.MEAN("value"))).df, "value")


@query(f"WITH {EV} SELECT event_type, 'm' AS model, count(*) AS n, round(var_samp(value), 4) AS sigma2, true AS ok FROM ev WHERE day >= DATE '{SPLIT}' GROUP BY 1")
def refit_mean(spark, sf):
    all_ = events_daily(spark, sf)
    mt = lc.refit(lc.model(_train(spark, sf), m=M.MEAN("value")), all_.filter(F.col("day") >= SPLIT))
    return rounded(lc.glance(mt), "sigma2")


@query(
    f"""WITH {EV}, hs AS (SELECT CAST(unnest(range(1, {H + 1})) AS INT) AS h), w AS (SELECT *, value - lag(value) OVER v AS d1, value - lag(value, 7) OVER v AS d7 FROM ev WINDOW v AS (PARTITION BY event_type ORDER BY day)),
s AS (SELECT event_type, max(day) AS last, count(*) AS n, avg(value) AS m, var_samp(value) AS vm, arg_max(value, day) AS y, avg(d1 * d1) AS v1, avg(d1) AS b, var_samp(d1) AS vd, list(value ORDER BY day)[-7:] AS tail, avg(d7 * d7) AS v7 FROM w GROUP BY 1),
f AS (SELECT event_type, last, h, unnest(['mean', 'naive', 'drift', 'snaive']) AS model, unnest([m, y, y + b * h, tail[(h - 1) % 7 + 1]]) AS mu, unnest([sqrt(vm * (1 + 1.0 / n)), sqrt(v1 * h), sqrt(vd * h * (1 + h / (n - 1.0))), sqrt(v7 * ((h - 1) // 7 + 1))]) AS sigma FROM s, hs)
SELECT event_type, model, last + h AS day, h, round(mu, 4) + 0.0 AS mu, round(sigma, 4) AS sigma FROM f"""
)
def stream_update(spark, sf):
    defs = {"mean": M.MEAN("value"), "naive": M.NAIVE("value"), "drift": M.DRIFT("value"), "snaive": M.SNAIVE("value", 7)}
    mt = stream(lc.model(_train(spark, sf), **defs), events_daily(spark, sf).filter(F.col("day") >= SPLIT))
    return rounded(lc.forecast(mt, H).df.drop("mean"), "mu", "sigma")


@query()
def generate_paths(spark, sf):
    mt = lc.model(_train(spark, sf), naive=M.NAIVE("value"), mean=M.MEAN("value"))
    return lc.generate(mt, H, times=3, seed=1).df


@query()
def generate_bootstrap(spark, sf):
    return lc.generate(lc.model(_train(spark, sf), snaive=M.SNAIVE("value", 7)), H, times=3, seed=1, bootstrap=True, block=2).df


@query()
def fc_simulated(spark, sf):
    fc = lc.forecast(lc.model(_train(spark, sf), naive=M.NAIVE("value")), H, simulate=True, times=200, seed=1)
    return fc.df.select("event_type", "model", "day", "h", r("mean").alias("mean"), r(quantile(fc, 0.9)).alias("q90"))


# numpy-backed model class of a user: simple exponential smoothing with a fixed weight
class _Smooth:
    def __init__(self, y, weight):
        self.y, self.weight = y, weight
        level, self.fit_ = y[0], []
        for v in y:
            self.fit_.append(level)
            level = weight * v + (1 - weight) * level
        self.level = level
        self.sd = float((sum((a - b) ** 2 for a, b in zip(y, self.fit_, strict=True)) / max(len(y) - 1, 1)) ** 0.5)

    def forecast(self, h):
        return [self.level] * h, [self.sd * (1 + (k * self.weight**2)) ** 0.5 for k in range(h)]

    def fitted(self):
        return self.fit_


smoothing = M.new_model_class("SMOOTH", lambda y, period, index, weight=0.5: _Smooth(y, weight), {"weight": lambda w: w})


@query(
    f"""WITH RECURSIVE {TRAIN}, lev(event_type, t, fit, level) AS (SELECT event_type, 1::BIGINT, value, value FROM tr WHERE t = 1
  UNION ALL SELECT l.event_type, l.t + 1, l.level, 0.5 * tr.value + 0.5 * l.level FROM lev l JOIN tr ON tr.event_type = l.event_type AND tr.t = l.t + 1),
s AS (SELECT event_type, sqrt(sum((value - fit) ** 2) / (count(*) - 1)) AS sd, arg_max(level, t) AS level, max(day) AS last FROM lev JOIN tr USING (event_type, t) GROUP BY 1)
SELECT event_type, last + h AS day, h, 'm' AS model, round(level, 4) AS mu, round(sd * sqrt(1 + (h - 1) * 0.25), 4) AS sigma, round(level, 4) AS mean FROM s, hs"""
)
def fc_python_model(spark, sf):
    return _fc(spark, sf, smoothing("value ~ weight(0.5)"))


@query(f"WITH {TRAIN}, d AS (SELECT *, stddev_samp(value - l1) OVER (PARTITION BY event_type) AS sd FROM tr) SELECT event_type, 'm' AS model, day, value, l1 AS fitted, round(value - l1, 4) AS resid, round(value - l1, 4) AS innov FROM d WHERE abs(value - l1) > 1.5 * sd")
def outlier_rows(spark, sf):
    return rounded(lc.outliers(lc.model(_train(spark, sf), m=M.NAIVE("value")), 1.5), "resid", "innov")


@query(f"WITH {TRAIN} SELECT event_type, 'm' AS model, h, round(1 + h / (count(*) - 1.0), 4) AS response FROM tr, hs GROUP BY event_type, h")
def impulse_response(spark, sf):
    return rounded(lc.irf(lc.model(_train(spark, sf), m=M.DRIFT("value")), H), "response")


_ACF = """(sum(CASE WHEN {b} IS NOT NULL AND {y} IS NOT NULL THEN {y} * {b} END) - avg({y}) * (sum(CASE WHEN {b} IS NOT NULL AND {y} IS NOT NULL THEN {y} + {b} END)) + count(CASE WHEN {b} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) * avg({y}) ** 2)
 / (sum({y} * {y}) - count({y}) * avg({y}) ** 2)"""


@query(
    f"""WITH {TRAIN}, e AS (SELECT event_type, day, value - l7 AS i FROM tr), f AS (SELECT *, lag(i) OVER (PARTITION BY event_type ORDER BY day) AS b FROM e),
a AS (SELECT event_type, count(i) AS n, {_ACF.format(y="i", b="b")} AS r FROM f GROUP BY 1)
SELECT event_type, 'm' AS model, round(n * (n + 2) * r * r / (n - 1), 4) AS statistic, 'ljung_box' AS test FROM a"""
)
def hypothesis_test(spark, sf):
    mt = lc.model(_train(spark, sf), m=M.SNAIVE("value", 7))
    return rounded(lc.hypothesize(mt, {"ljung_box": lc.ljung_box}), "statistic")


@query(
    f"""WITH {EV}, w AS (SELECT *, row_number() OVER v AS t, count(*) OVER (PARTITION BY event_type) AS size, avg(value) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ma FROM ev WINDOW v AS (PARTITION BY event_type ORDER BY day)),
x AS (SELECT *, CASE WHEN t > 3 AND t <= size - 3 THEN ma END AS trend, (t - 1) % 7 AS s FROM w), p AS (SELECT event_type, s, avg(value - trend) AS m FROM x GROUP BY ALL),
q AS (SELECT *, m - avg(m) OVER (PARTITION BY event_type) AS season FROM p)
SELECT event_type, day, value, round(trend, 4) AS trend, round(season, 4) AS season, round(value - season, 4) AS season_adjust, round(value - trend - season, 4) AS remainder FROM x JOIN q USING (event_type, s)"""
)
def decomposed(spark, sf):
    return rounded(decompose(events_daily(spark, sf), "value", 7).df, "trend", "season", "season_adjust", "remainder")


@query(
    f"""WITH {TRAIN}, w AS (SELECT *, avg(value) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ma FROM tr),
x AS (SELECT *, CASE WHEN t > 3 AND t <= size - 3 THEN ma END AS trend, (t - 1) % 7 AS s FROM w), p AS (SELECT event_type, s, avg(value - trend) AS m FROM x GROUP BY ALL),
q AS (SELECT *, m - avg(m) OVER (PARTITION BY event_type) AS season FROM p), a AS (SELECT x.*, season, value - season AS adj FROM x JOIN q USING (event_type, s)),
b AS (SELECT *, adj - lag(adj) OVER (PARTITION BY event_type ORDER BY day) AS d FROM a), l AS (SELECT event_type, arg_max(adj, day) AS y, avg(d * d) AS s2, max(day) AS last, max(t) AS n FROM b GROUP BY 1)
SELECT l.event_type, last + h AS day, h, 'decomposition' AS model, round(y + season, 4) AS mean, round(sqrt(s2 * h), 4) AS sigma FROM l JOIN hs ON true JOIN q ON q.event_type = l.event_type AND q.s = (n + h - 1) % 7"""
)
def fc_decomposition(spark, sf):
    fit = decomposition_model("value", 7).fit(_train(spark, sf))
    return rounded(fit.forecast(H).df, "mean", "sigma").select("event_type", "day", "h", "model", "mean", "sigma")


# ---------------------------------------------------------------- distributions and accuracy

_Z = {80: 1.2815515655446008, 95: 1.959963984540054}


@query(
    f"""WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, arg_max(value, day) AS y, avg((value - l1) ** 2) AS s2 FROM tr GROUP BY 1)
SELECT event_type, last + h AS day, h, round(y - {_Z[80]} * sqrt(s2 * h), 4) AS "80%_lower", round(y + {_Z[80]} * sqrt(s2 * h), 4) AS "80%_upper",
 round(y - {_Z[95]} * sqrt(s2 * h), 4) AS "95%_lower", round(y + {_Z[95]} * sqrt(s2 * h), 4) AS "95%_upper" FROM st, hs"""
)
def hilo_80_95(spark, sf):
    fc = lc.forecast(lc.model(_train(spark, sf), m=M.NAIVE("value")), H)
    out = unpack_hilo(hilo(fc).df, ["80%", "95%"])
    return out.select("event_type", "day", "h", *[(F.round(F.col(f"`{p}%_{e}`"), 4) + 0.0).alias(f"{p}%_{e}") for p in (80, 95) for e in ("lower", "upper")])


@query(f"WITH {EV} SELECT event_type, day, round(value, 4) AS mu, round(n / {_Z[95]}, 4) AS sigma FROM ev")
def dist_from_interval(spark, sf):
    df = events_daily(spark, sf).df.select("event_type", "day", (F.col("value") - F.col("n")).alias("lo"), (F.col("value") + F.col("n")).alias("hi"))
    return rounded(from_interval(df, "lo", "hi", 95), "mu", "sigma").select("event_type", "day", "mu", "sigma")


SCORE = f"""{TRAIN}, st AS (SELECT event_type, max(day) AS last, count(*) AS n, list(value ORDER BY day)[-7:] AS tail, avg((value - l7) ** 2) AS s7, arg_max(value, day) AS y, avg((value - l1) ** 2) AS s1, avg(abs(value - l7)) AS qa, avg((value - l7) ** 2) AS qs FROM tr GROUP BY 1),
fc AS (SELECT 'naive' AS model, event_type, last + h AS day, h, y AS mu, sqrt(s1 * h) AS sd, qa, qs FROM st, hs UNION ALL SELECT 'snaive', event_type, last + h, h, tail[(h - 1) % 7 + 1], sqrt(s7 * ((h - 1) // 7 + 1)), qa, qs FROM st, hs),
sc AS (SELECT fc.*, value AS a, value - mu AS e FROM fc LEFT JOIN ev USING (event_type, day)),
sl AS (SELECT *, a - lag(a) OVER w AS dy, lag(e) OVER w AS eb FROM sc WINDOW w AS (PARTITION BY model, event_type ORDER BY day))"""


def _scored(spark: SparkSession, sf: str, measures: dict, by: list[str] | None = None) -> DataFrame:
    fc = lc.forecast(lc.model(_train(spark, sf), naive=M.NAIVE("value"), snaive=M.SNAIVE("value", 7)), H)
    out = acc.accuracy(fc, events_daily(spark, sf), measures, by, 7)
    return rounded(out, *measures)


_POINT_SQL = f"""round(avg(e), 4) + 0.0 AS ME, round(sqrt(avg(e * e)), 4) AS RMSE, round(avg(abs(e)), 4) AS MAE, round(avg(100 * e / nullif(a, 0)), 4) + 0.0 AS MPE, round(avg(abs(100 * e / nullif(a, 0))), 4) AS MAPE,
 round(avg(abs(e / qa)), 4) AS MASE, round(sqrt(avg(e * e / qs)), 4) AS RMSSE, round({_ACF.format(y="e", b="eb")}, 4) + 0.0 AS ACF1"""


@query(f"WITH {SCORE} SELECT model, event_type, 'Test' AS type, {_POINT_SQL} FROM sl GROUP BY 1, 2")
def acc_point_test(spark, sf):
    return _scored(spark, sf, dict(ms.point_accuracy_measures))


@query(
    f"""WITH {TRAIN}, q AS (SELECT event_type, avg(abs(value - l7)) AS qa, avg((value - l7) ** 2) AS qs FROM tr GROUP BY 1),
x AS (SELECT event_type, 'naive' AS model, day, value AS a, value - l1 AS e FROM tr UNION ALL SELECT event_type, 'snaive', day, value, value - l7 FROM tr),
sl AS (SELECT x.*, qa, qs, lag(e) OVER (PARTITION BY event_type, model ORDER BY day) AS eb FROM x JOIN q USING (event_type))
SELECT event_type, model, 'Training' AS type, {_POINT_SQL} FROM sl GROUP BY 1, 2"""
)
def acc_point_train(spark, sf):
    mt = lc.model(_train(spark, sf), naive=M.NAIVE("value"), snaive=M.SNAIVE("value", 7))
    return rounded(acc.accuracy_training(mt, period=7), *ms.point_accuracy_measures)


@query(
    f"""WITH {SCORE}, d AS (SELECT *, sign(dy) = sign(dy - e) AS ok FROM sl)
SELECT model, event_type, 'Test' AS type, round(avg(ok::INT), 4) AS MDA, round(avg(abs(dy) * CASE WHEN ok THEN 1 ELSE -1 END), 4) + 0.0 AS MDV, round(100 * avg(abs(dy / nullif(a, 0)) * CASE WHEN ok THEN 1 ELSE -1 END), 4) + 0.0 AS MDPV,
 round(avg(atan(abs(100 * e / nullif(a, 0)))), 4) AS MAAPE, round(avg(e * e), 2) AS MSE FROM d GROUP BY 1, 2"""
)
def acc_directional(spark, sf):
    out = _scored(spark, sf, {**ms.directional_accuracy_measures, "MAAPE": ms.MAAPE, "MSE": ms.MSE})
    return out.withColumn("MSE", F.round("MSE", 2))


_Q95 = f"mu + {1.6448536269514715} * sd"


@query(
    f"""WITH {SCORE}, i AS (SELECT *, mu - {_Z[95]} * sd AS lo, mu + {_Z[95]} * sd AS hi, {_Q95} AS q FROM sl), p AS (SELECT *, CASE WHEN a >= q THEN 0.95 * (a - q) ELSE 0.05 * (q - a) END AS pin FROM i)
SELECT model, event_type, 'Test' AS type, round(avg(hi - lo + CASE WHEN a < lo THEN 40 * (lo - a) WHEN a > hi THEN 40 * (a - hi) ELSE 0 END), 4) AS winkler, round(2 * avg(pin), 4) AS pinball, round(avg(pin / qa), 4) AS scaled_pinball FROM p GROUP BY 1, 2"""
)
def acc_interval(spark, sf):
    return _scored(spark, sf, dict(ms.interval_accuracy_measures))


_PROBS = ((0.05, -1.6448536269514726), (0.25, -0.6744897501960817), (0.5, 0.0), (0.75, 0.6744897501960817), (0.95, 1.6448536269514715))


@query(
    f"""WITH {SCORE}, p AS (SELECT sl.*, p, mu + z * sd AS q FROM sl, (VALUES {", ".join(f"({p}::DOUBLE, {z}::DOUBLE)" for p, z in _PROBS)}) v(p, z))
SELECT model, event_type, 'Test' AS type, round(2 * avg(CASE WHEN a >= q THEN p * (a - q) ELSE (1 - p) * (q - a) END), 4) AS qs FROM p GROUP BY 1, 2"""
)
def acc_quantile(spark, sf):
    return _scored(spark, sf, {"qs": ms.quantile_score})


@query(
    f"""WITH {SCORE}, z AS (SELECT *, e / sd AS z FROM sl), ph AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) AS d FROM z),
c AS (SELECT *, CASE WHEN z > 7 THEN 1.0 WHEN z < -7 THEN 0.0 ELSE 0.5 + d * list_reduce(list_transform(range(0, 121), lambda k: z * list_product([1.0::DOUBLE] || list_transform(range(1, k + 1), lambda j: z * z / (2 * j + 1)))), lambda x, y: x + y) END AS cdf FROM ph)
SELECT model, event_type, 'Test' AS type, round(avg(sd * (z * (2 * cdf - 1) + 2 * d - 1 / sqrt(pi()))), 4) AS CRPS FROM c GROUP BY 1, 2"""
)
def acc_crps(spark, sf):
    return _scored(spark, sf, {"CRPS": ms.CRPS})


@query(
    f"""WITH {SCORE}, p AS (SELECT sl.*, p, mu + z * sd AS q FROM sl, (VALUES {", ".join(f"({k / 100}::DOUBLE, {z_of(k / 100)!r}::DOUBLE)" for k in range(1, 100))}) v(p, z))
SELECT model, event_type, 'Test' AS type, round(2 * avg(CASE WHEN a >= q THEN p * (a - q) ELSE (1 - p) * (q - a) END), 4) AS percentile FROM p GROUP BY 1, 2"""
)
def acc_percentile(spark, sf):
    return _scored(spark, sf, {"percentile": ms.percentile_score})


@query(
    f"""WITH {SCORE}, b AS (SELECT event_type, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM sl WHERE model = 'snaive' GROUP BY 1)
SELECT model, event_type, 'Test' AS type, round(1 - sqrt(avg(e * e)) / any_value(rmse), 4) + 0.0 AS RMSE, round(1 - avg(abs(e)) / any_value(mae), 4) + 0.0 AS MAE FROM sl JOIN b USING (event_type) GROUP BY 1, 2"""
)
def acc_skill(spark, sf):
    fc = lc.forecast(lc.model(_train(spark, sf), naive=M.NAIVE("value"), snaive=M.SNAIVE("value", 7)), H)
    return rounded(acc.skill_score(fc, events_daily(spark, sf), {"RMSE": ms.RMSE, "MAE": ms.MAE}, period=7), "RMSE", "MAE")


@query(f"WITH {SCORE} SELECT model, h, 'Test' AS type, round(avg(e), 4) + 0.0 AS ME, round(avg(abs(e)), 4) AS MAE FROM sl GROUP BY 1, 2")
def acc_by_horizon(spark, sf):
    return _scored(spark, sf, {"ME": ms.ME, "MAE": ms.MAE}, ["model", "h"])


@query(f"WITH {EV} SELECT CAST(count(*) * 3 AS BIGINT) AS n, max(day) + 1 AS first, max(day) + 3 AS last FROM ev WHERE day = (SELECT max(day) FROM ev)")
def missing_future(spark, sf):
    fc = lc.forecast(lc.model(_train(spark, sf), m=M.NAIVE("value")), H + 3)
    return acc.missing_future(fc, events_daily(spark, sf))


# ---------------------------------------------------------------- combinations


def _cmb(spark: SparkSession, sf: str, c: object) -> DataFrame:
    return rounded(lc.forecast(lc.model(_train(spark, sf), c=c), H).df, "mu", "sigma", "mean")


def _cmb_sql(w: str, v: str) -> str:
    return f"""WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, list(value ORDER BY day)[-7:] AS tail, avg((value - l7) ** 2) AS s7, arg_max(value, day) AS y, avg((value - l1) ** 2) AS s1,
 1 / var_samp(value - l1) AS i1, 1 / var_samp(value - l7) AS i7, corr(value - l1, value - l7) FILTER (l7 IS NOT NULL) AS rho FROM tr GROUP BY 1),
f AS (SELECT *, {w} AS w, {v} AS v, sqrt(s1 * h) AS a, sqrt(s7 * ((h - 1) // 7 + 1)) AS b, tail[(h - 1) % 7 + 1] AS t FROM st, hs)
SELECT event_type, last + h AS day, h, 'c' AS model, round(w * y + v * t, 4) AS mu, round(sqrt((w * a) ** 2 + (v * b) ** 2 + 2 * w * v * a * b * rho), 4) AS sigma, round(w * y + v * t, 4) AS mean FROM f"""


@query(_cmb_sql("0.5", "0.5"))
def cmb_equal(spark, sf):
    return _cmb(spark, sf, combination_ensemble(M.NAIVE("value"), M.SNAIVE("value", 7)))


@query(_cmb_sql("0.75", "0.25"))
def cmb_weighted(spark, sf):
    return _cmb(spark, sf, combination_weighted(M.NAIVE("value"), M.SNAIVE("value", 7), weights=(3, 1)))


@query(_cmb_sql("i1 / (i1 + i7)", "i7 / (i1 + i7)"))
def cmb_invvar(spark, sf):
    return _cmb(spark, sf, combination_ensemble(M.NAIVE("value"), M.SNAIVE("value", 7), weights="inv_var"))


@query(_cmb_sql("2.0", "-0.5"))
def cmb_arithmetic(spark, sf):
    return _cmb(spark, sf, 2 * M.NAIVE("value") - M.SNAIVE("value", 7) / 2)


# ---------------------------------------------------------------- features


def _feat_sql(cols: str) -> str:
    return f"""WITH d AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
f AS (SELECT *, lag(quantity) OVER w AS b, lag(n) OVER w AS nb FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY day)) SELECT l_returnflag, {cols} FROM f GROUP BY 1"""


@query(_feat_sql("count(quantity) AS n, round(avg(quantity), 4) AS mean, round(stddev_samp(quantity), 4) AS sd, min(quantity) AS min, max(quantity) AS max"))
def feat_basic(spark, sf):
    return rounded(feat.features(_shipped(spark, sf), "quantity", [feat.basic]), "mean", "sd")


@query(_feat_sql("round(quantile_cont(quantity, 0.0), 4) AS q0, round(quantile_cont(quantity, 0.25), 4) AS q25, round(quantile_cont(quantity, 0.5), 4) AS q50, round(quantile_cont(quantity, 0.75), 4) AS q75, round(quantile_cont(quantity, 1.0), 4) AS q100"))
def feat_quantiles(spark, sf):
    return rounded(feat.features(_shipped(spark, sf), "quantity", [feat.quantiles]), "q0", "q25", "q50", "q75", "q100")


@query(_feat_sql(f"round({_ACF.format(y='quantity', b='b')}, 4) + 0.0 AS acf1, round(avg(quantity - b), 4) + 0.0 AS diff_mean, round(stddev_samp(quantity - b), 4) AS diff_sd, CAST(sum((quantity <> b)::INT) AS BIGINT) AS crossings"))
def feat_acf1(spark, sf):
    return rounded(feat.features(_shipped(spark, sf), "quantity", [feat.acf1, feat.differences]), "acf1", "diff_mean", "diff_sd")


@query(_feat_sql(", ".join(f"round(avg({v}), 4) AS {v}_mean, round(stddev_samp({v}), 4) AS {v}_sd, count({v}) AS {v}_n, min({v}) AS {v}_min, max({v}) AS {v}_max" for v in ("n", "quantity"))).replace("min(n)", "min(n)::DOUBLE").replace("max(n)", "max(n)::DOUBLE"))
def feat_all_vars(spark, sf):
    return rounded(feat.features_all(_shipped(spark, sf), [feat.basic]), "n_mean", "n_sd", "quantity_mean", "quantity_sd")


@feat.python_feature(["longest", "period"])
def longest_rise(x, period):
    best = now = 0
    for a, b in zip(x[:-1], x[1:], strict=True):
        now = now + 1 if b > a else 0
        best = max(best, now)
    return {"longest": float(best), "period": float(period)}


@query(
    """WITH d AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), u AS (SELECT *, q > lag(q) OVER w AS up, row_number() OVER w AS t FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY day)),
g AS (SELECT *, t - row_number() OVER (PARTITION BY l_returnflag, up ORDER BY day) AS k FROM u), c AS (SELECT l_returnflag, k, count(*) AS c FROM g WHERE up GROUP BY ALL)
SELECT l_returnflag, max(c)::DOUBLE AS rise_longest, 7.0::DOUBLE AS rise_period FROM c GROUP BY 1"""
)
def feat_python(spark, sf):
    return feat.features(_shipped(spark, sf), "quantity", {"rise": longest_rise})


# ---------------------------------------------------------------- transformations and regressors


@query("SELECT o_orderkey, round(o_totalprice, 2) AS back, round((o_totalprice ** 0.5 - 1) / 0.5, 4) AS half, round(ln(o_totalprice), 4) AS zero, round((o_totalprice ** -1.0 - 1) / -1.0, 6) AS inverse FROM orders")
def boxcox_roundtrip(spark, sf):
    x = F.col("o_totalprice")
    return read_table(spark, sf, "orders").select("o_orderkey", F.round(inv_box_cox(box_cox(x, 0.3), 0.3), 2).alias("back"), r(box_cox(x, 0.5)).alias("half"), r(box_cox(x, 0)).alias("zero"), r(box_cox(x, -1), 6).alias("inverse"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS back, round(ln(2 * sqrt(o_totalprice + 1)), 4) AS link FROM orders")
def transform_chain(spark, sf):
    t, x = (2 * (Transformation() + 1).sqrt()).log(), F.col("o_totalprice")
    return read_table(spark, sf, "orders").select("o_orderkey", F.round(t.inverse(t(x)), 2).alias("back"), r(t(x)).alias("link"))


@query(
    f"""WITH {EV}, t AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) AS t, (day - DATE '1970-01-01') % 7 AS s FROM ev)
SELECT event_type, day, t::DOUBLE AS trend, greatest(t - 10, 0)::DOUBLE AS trend_10, {", ".join(f"CASE WHEN s + 1 = {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS season_{k}" for k in range(2, 8))},
 round(cos(2 * pi() * t / 7), 6) + 0.0 AS C1_7, round(sin(2 * pi() * t / 7), 6) + 0.0 AS S1_7 FROM t"""
)
def regressor_columns(spark, sf):
    f = events_daily(spark, sf)
    df = f.df.withColumns({"__t": F.row_number().over(f.window()), "__s": F.datediff("day", F.lit("1970-01-01").cast("date"))})
    waves = {k: r(c, 6) for k, c in fourier(F.col("__t"), 7, 1).items()}
    return df.select("event_type", "day", *[c.alias(k) for k, c in {**trend(F.col("__t"), (10,)), **season(F.col("__s"), 7), **waves}.items()])


# ---------------------------------------------------------------- reconciliation

_RKEYS = "region, ra AS region__agg, nation, na AS nation__agg"
RTRAIN = f"""{TREE}, rt AS (SELECT *, lag(y, 12) OVER (PARTITION BY node ORDER BY month) AS l12 FROM named), rh AS (SELECT CAST(unnest(range(1, 4)) AS INT) AS h),
rs AS (SELECT node, any_value(region) AS region, any_value(ra) AS ra, any_value(nation) AS nation, any_value(na) AS na, max(month) AS last, list(y ORDER BY month)[-12:] AS tail, avg((y - l12) ** 2) AS s2 FROM rt GROUP BY node),
rf AS (SELECT rs.*, h, CAST(last + to_months(h) AS DATE) AS month, tail[h] AS f, sqrt(s2) AS sd FROM rs, rh)"""


def _reconciled(spark: SparkSession, sf: str, plan: rec.Reconcile) -> DataFrame:
    mt = lc.model(_tree(spark, sf), base=M.SNAIVE("y", 12))
    fc = lc.forecast(rec.reconcile(mt, rec=plan), 3).df.filter("model = 'rec'")
    return fc.select("region", "region__agg", "nation", "nation__agg", "month", "h", r("mean", 3).alias("mean"), r("sigma", 3).alias("sigma"))


@query(
    f"""WITH {RTRAIN}, s AS ({_SMAT}) SELECT n.region, n.ra AS region__agg, n.nation, n.na AS nation__agg, l.month, l.h, round(sum(l.f), 3) AS mean, round(sqrt(sum(l.sd ** 2)), 3) AS sigma
FROM s JOIN rf l ON l.node = s.leaf JOIN rs n ON n.node = s.node GROUP BY ALL"""
)
def rec_bottom_up(spark, sf):
    return _reconciled(spark, sf, rec.bottom_up("base"))


def _shares(p: str) -> str:
    return f"""WITH {RTRAIN}, s AS ({_SMAT}), top AS (SELECT month, y FROM named WHERE ra), p AS (SELECT node, {p} AS p FROM named n JOIN top t USING (month) WHERE NOT na GROUP BY node),
q AS (SELECT s.node, sum(p) AS p FROM s JOIN p ON p.node = s.leaf GROUP BY 1)
SELECT n.region, n.ra AS region__agg, n.nation, n.na AS nation__agg, t.month, t.h, round(p * t.f, 3) AS mean, round(abs(p) * t.sd, 3) AS sigma FROM q JOIN rs n USING (node) JOIN rf t ON t.ra"""


@query(_shares("avg(n.y / nullif(t.y, 0))"))
def rec_top_down_avgprop(spark, sf):
    return _reconciled(spark, sf, rec.top_down("base", "average_proportions"))


@query(_shares("avg(n.y) / avg(t.y)"))
def rec_top_down_propavg(spark, sf):
    return _reconciled(spark, sf, rec.top_down("base", "proportion_averages"))


_DOWN = f"""{RTRAIN}, a AS (SELECT *, f / nullif(sum(f) OVER (PARTITION BY h), 0) AS p FROM rf WHERE NOT ra AND na),
b AS (SELECT *, f / nullif(sum(f) OVER (PARTITION BY region, h), 0) AS p FROM rf WHERE NOT na)"""


@query(
    f"""WITH {_DOWN}, top AS (SELECT * FROM rf WHERE ra), x AS (SELECT region, ra, nation, na, month, h, f AS mean, sd FROM top
  UNION ALL SELECT a.region, a.ra, a.nation, a.na, a.month, a.h, a.p * t.f, abs(a.p) * t.sd FROM a JOIN top t USING (h)
  UNION ALL SELECT b.region, b.ra, b.nation, b.na, b.month, b.h, b.p * a.p * t.f, abs(b.p * a.p) * t.sd FROM b JOIN a ON a.region = b.region AND a.h = b.h JOIN top t ON t.h = b.h)
SELECT {_RKEYS}, month, h, round(mean, 3) AS mean, round(sd, 3) AS sigma FROM x"""
)
def rec_top_down_fcprop(spark, sf):
    return _reconciled(spark, sf, rec.top_down("base"))


@query(
    f"""WITH {_DOWN}, x AS (SELECT region, ra, nation, na, month, h, f AS mean, sd FROM a
  UNION ALL SELECT b.region, b.ra, b.nation, b.na, b.month, b.h, b.p * a.f, abs(b.p) * a.sd FROM b JOIN a ON a.region = b.region AND a.h = b.h
  UNION ALL SELECT NULL, true, NULL, true, month, h, sum(f), sqrt(sum(sd ** 2)) FROM a GROUP BY month, h)
SELECT {_RKEYS}, month, h, round(mean, 3) AS mean, round(sd, 3) AS sigma FROM x"""
)
def rec_middle_out(spark, sf):
    return _reconciled(spark, sf, rec.middle_out("base", "region"))


def _mint(w: str) -> str:
    """Minimum trace reconciliation in SQL: the constraint form, with a Gauss-Jordan elimination over lists.  ``w`` gives (i, j, w)."""
    return f"""WITH RECURSIVE {RTRAIN}, s AS ({_SMAT}), e AS (SELECT node, month, y - l12 AS e FROM rt), t AS (SELECT count(DISTINCT month) AS n FROM e),
full_months AS (SELECT month FROM e GROUP BY month HAVING count(e) = count(*)),
cv AS (SELECT a.node AS i, b.node AS j, sum(a.e * b.e) / n AS c, sum(a.e ** 2 * b.e ** 2) AS q, n FROM e a JOIN e b USING (month) JOIN full_months USING (month), t GROUP BY a.node, b.node, n),
own AS (SELECT node, sum(e * e) / n AS tar FROM e, t GROUP BY node, n),
co AS (SELECT cv.*, a.c AS ci, b.c AS cj, cv.c / sqrt(a.c * b.c) AS r FROM cv JOIN cv a ON a.i = cv.i AND a.j = cv.i JOIN cv b ON b.i = cv.j AND b.j = cv.j),
lam AS (SELECT greatest(least(sum((q / (ci * cj) - n * r * r) / (n * (n - 1))) / sum(r * r), 1), 0) AS lam FROM co WHERE i <> j),
w AS ({w}), up AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM rs WHERE na), nd AS (SELECT node, na, row_number() OVER (ORDER BY node) AS k FROM rs),
u AS (SELECT node AS a, node AS j, 1 AS u FROM up UNION ALL SELECT s.node, leaf, -1 FROM s JOIN up USING (node)),
wu AS (SELECT w.i, u.a, sum(w.w * u.u) AS x FROM w JOIN u ON w.j = u.j GROUP BY ALL), m AS (SELECT u.a, wu.a AS b, sum(u.u * wu.x) AS x FROM u JOIN wu ON u.j = wu.i GROUP BY ALL),
ls AS (SELECT up.k AS k, 0 AS side, b.k AS c, coalesce(x, 0)::DOUBLE AS x FROM up, up b LEFT JOIN m ON m.a = up.node AND m.b = b.node
  UNION ALL SELECT up.k, 1, nd.k, coalesce(u, 0)::DOUBLE FROM up, nd LEFT JOIN u ON u.a = up.node AND u.j = nd.node),
g0 AS (SELECT list(r ORDER BY k) AS g FROM (SELECT k, list(x ORDER BY side, c) AS r FROM ls GROUP BY k)),
gj(k, g) AS (SELECT 0, g FROM g0 UNION ALL SELECT k + 1, list_transform(g, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / r[k + 1])
  ELSE list_transform(r, lambda v, c: v - r[k + 1] / g[k + 1][k + 1] * g[k + 1][c]) END) FROM gj WHERE k < len(g)),
x AS (SELECT up.node AS a, nd.node AS j, g[up.k][len(g) + nd.k] AS x FROM gj, up, nd WHERE gj.k = len(g)),
wx AS (SELECT wu.i AS leaf, x.j, sum(wu.x * x.x) AS x FROM wu JOIN x USING (a) GROUP BY ALL),
p AS (SELECT l.node AS leaf, j.node AS j, (l.node = j.node)::INT - coalesce(x, 0) AS p FROM nd l, nd j LEFT JOIN wx ON wx.leaf = l.node AND wx.j = j.node WHERE NOT l.na),
sp AS (SELECT s.node AS i, p.j, sum(p.p) AS x FROM s JOIN p USING (leaf) GROUP BY ALL),
wr AS (SELECT w.i, w.j, w.w / sqrt(a.w * b.w) AS r FROM w JOIN w a ON a.i = w.i AND a.j = w.i JOIN w b ON b.i = w.j AND b.j = w.j),
mu AS (SELECT sp.i, rf.month, h, sum(x * f) AS mean FROM sp JOIN rf ON rf.node = sp.j GROUP BY ALL),
sg AS (SELECT a.i, f.h, sqrt(sum(a.x * b.x * r * f.sd * o.sd)) AS sigma FROM sp a JOIN sp b ON a.i = b.i JOIN wr ON wr.i = a.j AND wr.j = b.j JOIN rf f ON f.node = a.j JOIN rf o ON o.node = b.j AND o.h = f.h GROUP BY ALL)
SELECT rs.region, rs.ra AS region__agg, rs.nation, rs.na AS nation__agg, mu.month, mu.h, round(mean, 3) + 0.0 AS mean, round(sigma, 3) + 0.0 AS sigma FROM mu JOIN sg ON sg.i = mu.i AND sg.h = mu.h JOIN rs ON rs.node = mu.i"""


@query(_mint("SELECT node AS i, node AS j, 1.0::DOUBLE AS w FROM rs"))
def rec_ols(spark, sf):
    return _reconciled(spark, sf, rec.min_trace("base", "ols"))


@query(_mint("SELECT node AS i, node AS j, count(*)::DOUBLE AS w FROM s GROUP BY node"))
def rec_wls_struct(spark, sf):
    return _reconciled(spark, sf, rec.min_trace("base", "wls_struct"))


@query(_mint("SELECT i, j, c AS w FROM cv WHERE i = j"))
def rec_wls_var(spark, sf):
    return _reconciled(spark, sf, rec.min_trace("base", "wls_var"))


@query(_mint("SELECT i, j, (1 - lam) * c + CASE WHEN i = j THEN lam * tar ELSE 0 END AS w FROM cv JOIN own ON own.node = i, lam"))
def rec_mint_shrink(spark, sf):
    return _reconciled(spark, sf, rec.min_trace("base", "mint_shrink"))


_LOGS = f"""{RTRAIN.replace("rf AS (SELECT rs.*, h, CAST(last + to_months(h) AS DATE) AS month, tail[h] AS f, sqrt(s2) AS sd FROM rs, rh)", "rf AS (SELECT rs.*, h, CAST(last + to_months(h) AS DATE) AS month, (tail[h] + 1) * (1 + v2 / 2) - 1 AS f, sqrt(s2) AS sd FROM rs JOIN rv USING (node), rh)").replace("rs AS (SELECT", "rv AS (SELECT node, avg((ln(y + 1) - ln(l12 + 1)) ** 2) AS v2 FROM rt GROUP BY node), rs AS (SELECT")}"""


@query(_mint("SELECT i, j, (1 - lam) * c + CASE WHEN i = j THEN lam * tar ELSE 0 END AS w FROM cv JOIN own ON own.node = i, lam").replace(RTRAIN, _LOGS).replace(", round(sigma, 3) + 0.0 AS sigma", ""))
def rec_mint_shrink_log(spark, sf):
    """Forecasts that do not add up before: a transformed model's means."""
    mt = lc.model(_tree(spark, sf), base=M.SNAIVE("log(y + 1)", 12))
    fc = lc.forecast(rec.reconcile(mt, rec=rec.min_trace("base", "mint_shrink")), 3).df.filter("model = 'rec'")
    return fc.select("region", "region__agg", "nation", "nation__agg", "month", "h", r("mean", 3).alias("mean"))


# ---------------------------------------------------------------- tables with roles


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS count FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_rows(spark, sf):
    df = read_table(spark, sf, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value")
    return as_series(df, ("event_type",), "hour", Interval("hour"), check=False).duplicates()


@query(
    """SELECT r_name AS region, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS nation, n_nationkey % 2 = 1 AS nation__agg, CASE WHEN n_nationkey % 2 = 1 THEN '<aggregated>' ELSE n_name END AS text
FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def agg_vec_by_hand(spark, sf):
    df = read_table(spark, sf, "nation").join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = hi.agg_vec(df.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "n_nationkey"), "nation", F.col("n_nationkey") % 2 == 1)
    return out.select("region", "nation", "nation__agg", hi.format_key(out, "nation").alias("text"))


@query(
    f"""WITH {ORDERS}, t AS (SELECT region, grouping(region) = 1 AS agg, round(sum(price), 2) AS total FROM (SELECT CASE WHEN region <> 'ASIA' THEN region END AS region, price FROM o) GROUP BY GROUPING SETS ((), (region)))
SELECT CASE region WHEN 'EUROPE' THEN 'EU' ELSE region END AS region, agg AS region__agg, total, region IS NULL AND NOT agg AS missing, row_number() OVER (ORDER BY agg, CASE region WHEN 'EUROPE' THEN 'EU' ELSE region END NULLS FIRST) AS place FROM t"""
)
def agg_missing_recoded(spark, sf):
    cells = orders_monthly(spark, sf)
    gone = cells.with_columns({"region": F.when(F.col("region") != "ASIA", F.col("region")), "month": F.lit(1)})
    out = hi.recode(hi.aggregate_key(gone, "region", partial={"price": "sum"}).df, "region", {"EUROPE": "EU"})
    place = F.row_number().over(Window.orderBy(*hi.key_order(["region"])))  # seven rows
    return out.select("region", "region__agg", F.round("sum_price", 2).alias("total"), hi.is_missing(out, "region").alias("missing"), place.alias("place"))


_BOTH = f"""{EV}, lg AS (SELECT event_type, day, unnest(['n', 'value']) AS response, unnest([n::DOUBLE, value]) AS value FROM ev),
tr AS (SELECT *, lag(value, 7) OVER (PARTITION BY event_type, response ORDER BY day) AS l7 FROM lg WHERE day < DATE '{SPLIT}'), hs AS (SELECT CAST(unnest(range(1, {H + 1})) AS INT) AS h)"""


@query(
    f"""WITH {_BOTH}, st AS (SELECT event_type, response, max(day) AS last, list(value ORDER BY day)[-7:] AS tail, avg((value - l7) ** 2) AS s2 FROM tr GROUP BY ALL)
SELECT event_type, response, last + h AS day, h, 'm' AS model, round(tail[(h - 1) % 7 + 1], 4) AS mu, round(sqrt(s2 * ((h - 1) // 7 + 1)), 4) AS sigma, round(tail[(h - 1) % 7 + 1], 4) AS mean FROM st, hs"""
)
def multi_forecast(spark, sf):
    return _fc(spark, sf, M.SNAIVE("vars(value, n)", 7))


@query(f"WITH {_BOTH} SELECT event_type, response, 'm' AS model, day, value, l7 AS fitted, round(value - l7, 4) + 0.0 AS resid, round(value - l7, 4) + 0.0 AS innov FROM tr")
def multi_augment(spark, sf):
    return rounded(lc.augment(lc.model(_train(spark, sf), m=M.SNAIVE("vars(value, n)", 7))).df, "resid", "innov")


@query(
    f"""WITH {_BOTH}, st AS (SELECT event_type, response, max(day) AS last, list(value ORDER BY day)[-7:] AS tail FROM tr GROUP BY ALL), e AS (SELECT event_type, response, lg.value - tail[(h - 1) % 7 + 1] AS e FROM st JOIN hs ON true JOIN lg USING (event_type, response) WHERE lg.day = last + h)
SELECT 'm' AS model, event_type, response, 'Test' AS type, round(avg(e), 4) + 0.0 AS ME, round(avg(abs(e)), 4) AS MAE FROM e GROUP BY ALL"""
)
def multi_accuracy(spark, sf):
    fc = lc.forecast(lc.model(_train(spark, sf), m=M.SNAIVE("vars(value, n)", 7)), H)
    return rounded(acc.accuracy(fc, events_daily(spark, sf).longer(["value", "n"]), {"ME": ms.ME, "MAE": ms.MAE}, period=7), "ME", "MAE")


@query(
    f"""WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, arg_max(value, day) AS y, avg((value - l1) ** 2) AS s2 FROM tr GROUP BY 1)
SELECT 'm' AS model, last + h AS day, round(sum(y), 4) AS mu, round(sqrt(sum(s2 * h)), 4) AS sigma, count(*) AS n FROM st, hs GROUP BY last, h"""
)
def fc_summarised(spark, sf):
    fc = lc.forecast(lc.model(_train(spark, sf), m=M.NAIVE("value")), H)
    return rounded(fc.group_by("model").summarise(mu=F.sum("mu"), sigma=F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))), n=F.count("*")).df, "mu", "sigma")


@query(
    f"""WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, ln(arg_max(value, day)) AS y, avg(ln(value / l1)) AS b FROM tr GROUP BY 1)
SELECT event_type, last + h AS day, round(exp(y + b * h), 4) AS median FROM st, hs"""
)
def fc_median(spark, sf):
    fc = lc.forecast(lc.model(_train(spark, sf), m=M.DRIFT("log(value)")), H)
    return rounded(point_forecasts(fc, {"median": lambda mean, median: median}).df.select("event_type", "day", "median"), "median")


@query(f"WITH {TRAIN} SELECT DISTINCT event_type, '<NAIVE>' AS naive, '<NULL model>' AS long FROM tr")
def models_formatted(spark, sf):
    return lc.model(_train(spark, sf), naive=M.NAIVE("value"), long=M.SNAIVE("value", 100)).formatted()


@query(f"WITH {TRAIN}, k AS (SELECT DISTINCT event_type FROM tr) SELECT event_type, model, model = 'long' AS \"null\" FROM k, (VALUES ('naive'), ('long')) m(model)")
def null_flags(spark, sf):
    return is_null_model(lc.model(_train(spark, sf), naive=M.NAIVE("value"), long=M.SNAIVE("value", 100)))


@query(f"WITH {TRAIN} SELECT 'long' AS model, 'too few values' AS error, count(DISTINCT event_type) AS count FROM tr")
def error_tally(spark, sf):
    return lc.model(_train(spark, sf), naive=M.NAIVE("value"), long=M.SNAIVE("value", 100)).errors()


@query(f"WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, avg(value) AS m, arg_max(value, day) AS y FROM tr GROUP BY 1) SELECT event_type, last + h AS day, h, unnest(['mean', 'naive']) AS model, round(unnest([m, y]), 4) AS mean FROM st, hs")
def bound_models(spark, sf):
    t = _train(spark, sf)
    fc = lc.forecast(lc.model(t, mean=M.MEAN("value")).union(lc.model(t, naive=M.NAIVE("value"))), H)
    return rounded(fc.df, "mean").select("event_type", "day", "h", "model", "mean")


@query(f"WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, avg(value) AS m, arg_max(value, day) AS y FROM tr GROUP BY 1) SELECT event_type, last + h AS day, h, unnest(['mean', 'naive']) AS model, round(unnest([m, y]), 4) AS mean FROM st, hs")
def bound_forecasts(spark, sf):
    t = _train(spark, sf)
    one, two = lc.forecast(lc.model(t, mean=M.MEAN("value")), H), lc.forecast(lc.model(t, naive=M.NAIVE("value")), H)
    return rounded(one.union(two).df, "mean").select("event_type", "day", "h", "model", "mean")


@query(f"WITH {TRAIN} SELECT event_type, day, 'm' AS model, round(ln(value / l1), 6) + 0.0 AS innov, round(value - l1, 4) + 0.0 AS resid, value AS response FROM tr")
def residual_kinds(spark, sf):
    mt = lc.model(_train(spark, sf), m=M.NAIVE("log(value)"))
    a = lc.residuals(mt).df.withColumnRenamed("resid", "innov").join(lc.residuals(mt, "response").df, ["event_type", "model", "day"])
    out = a.join(lc.response(mt).df, ["event_type", "day"])
    return out.withColumns({"innov": r("innov", 6), "resid": r("resid")}).select("event_type", "day", "model", "innov", "resid", "response")


@query(
    f"""WITH {TRAIN}, s AS (SELECT *, avg(value) OVER (PARTITION BY event_type, (t - 1) % 7) AS m FROM tr)
SELECT event_type, 'season' AS model, day, value, 0.0::DOUBLE AS level, round(m, 4) AS season, round(value - m, 4) + 0.0 AS remainder FROM s UNION ALL
SELECT event_type, 'trend', day, value, round(regr_intercept(value, t) OVER w + t * regr_slope(value, t) OVER w, 4), 0.0, round(value - regr_intercept(value, t) OVER w - t * regr_slope(value, t) OVER w, 4) + 0.0 FROM tr WINDOW w AS (PARTITION BY event_type)"""
)
def model_components(spark, sf):
    d = lc.components(lc.model(_train(spark, sf), season=M.SMEAN("value", 7), trend=M.TREND("value")))
    return rounded(d.df, "level", "season", "remainder")


@query(
    f"""WITH {TRAIN}, x AS (SELECT event_type, day, t, avg(value) OVER s AS smean, regr_intercept(value, t) OVER w + t * regr_slope(value, t) OVER w AS trend FROM tr
  WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), s AS (PARTITION BY event_type, (t - 1) % 7 ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING))
SELECT event_type, model, day, round(CASE WHEN model = 'smean' OR t > 3 THEN fitted END, 6) AS fitted FROM (SELECT event_type, t, day, unnest(['smean', 'trend', 'tslm']) AS model, unnest([smean, trend, trend]) AS fitted FROM x)"""
)
def hfitted_refits(spark, sf):
    mt = lc.model(_train(spark, sf), smean=M.SMEAN("value", 7), trend=M.TREND("value"), tslm=M.TSLM("value ~ trend()"))
    return lc.fitted(mt, 2).df.withColumn("fitted", r("fitted", 6))


@query(
    f"""WITH {TRAIN}, x AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS x FROM tr), s AS (SELECT event_type, max(day) AS last, arg_max(n, day) AS x1, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, regr_avgx(value, x) AS c, regr_sxx(value, x) AS sxx, regr_count(value, x) AS k,
 (regr_syy(value, x) - regr_slope(value, x) * regr_sxy(value, x)) / (regr_count(value, x) - 2) AS s2 FROM x GROUP BY 1)
SELECT event_type, last + h AS day, h, 'm' AS model, CASE WHEN h = 1 THEN round(a + b * x1, 4) END AS mu, CASE WHEN h = 1 THEN round(sqrt(s2 * (1 + 1.0 / k + (x1 - c) ** 2 / sxx)), 4) END AS sigma, CASE WHEN h = 1 THEN round(a + b * x1, 4) END AS mean FROM s, hs"""
)
def fc_tslm_lag(spark, sf):
    return _fc(spark, sf, M.TSLM("value ~ lag(n)"))


@query(
    f"""WITH {EV}, hs AS (SELECT CAST(unnest(range(1, {H + 1})) AS INT) AS h), hl AS (SELECT event_type, day, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY day) % 5 <> 2 THEN value END AS v FROM ev),
w AS (SELECT *, v - lag(v) OVER p AS d1, v - lag(v, 7) OVER p AS d7 FROM hl WINDOW p AS (PARTITION BY event_type ORDER BY day)),
s AS (SELECT event_type, count(*) AS n, [var_samp(v), avg(d1 * d1), var_samp(d1), avg(d7 * d7)] AS s FROM w GROUP BY 1)
SELECT event_type, model, n, round(x, 4) AS sigma2, true AS ok FROM (SELECT event_type, n, unnest(['mean', 'naive', 'drift', 'snaive']) AS model, unnest(s) AS x FROM s)"""
)
def stream_missing(spark, sf):
    both = events_daily(spark, sf)
    holes = both.with_columns({"value": F.when(F.row_number().over(both.window()) % 5 != 2, F.col("value"))})
    defs = {"mean": M.MEAN("value"), "naive": M.NAIVE("value"), "drift": M.DRIFT("value"), "snaive": M.SNAIVE("value", 7)}
    mt = stream(lc.model(holes.filter(F.col("day") < SPLIT), **defs), holes.filter(F.col("day") >= SPLIT))
    return rounded(lc.glance(mt), "sigma2")


@query(
    f"""WITH {SCORE.replace("fc AS (SELECT", "tq AS (SELECT event_type, avg(abs(d)) AS da, avg((l1v - m) ** 2) AS dm FROM (SELECT event_type, l1v, avg(l1v) OVER (PARTITION BY event_type) AS m, l7v - lag(l7v) OVER (PARTITION BY event_type ORDER BY day) AS d FROM (SELECT event_type, day, value - l1 AS l1v, value - l7 AS l7v FROM tr)) GROUP BY 1), fc AS (SELECT", 1)}
SELECT model, event_type, 'Test' AS type, round(avg(abs(e / da)), 4) AS both, round(sqrt(avg(e * e / dm)), 4) AS centred FROM sl JOIN tq USING (event_type) GROUP BY 1, 2"""
)
def acc_scales(spark, sf):
    return _scored(spark, sf, {"both": ms.with_args(ms.MASE, d=1, D=1), "centred": ms.with_args(ms.RMSSE, demean=True, d=1, D=0)})


@query(
    f"""WITH {TRAIN}, st AS (SELECT event_type, max(day) AS last, count(*) AS n, ln(arg_max(value, day)) AS y, avg(ln(value / l1)) AS b, var_samp(ln(value / l1)) AS s2 FROM tr GROUP BY 1),
f AS (SELECT event_type, value AS a, y + b * h AS mu, sqrt(s2 * h * (1 + h / (st.n - 1.0))) AS sd FROM st JOIN hs ON true JOIN ev USING (event_type) WHERE ev.day = last + h),
q AS (SELECT *, exp(mu + z * sd) AS q FROM f, (VALUES {", ".join(f"({k / 100}::DOUBLE, {z_of(k / 100)!r}::DOUBLE)" for k in range(1, 100))}) v(p, z))
SELECT 'm' AS model, event_type, 'Test' AS type, round(2 * avg(CASE WHEN a >= q THEN p * (a - q) ELSE (1 - p) * (q - a) END), 4) AS CRPS FROM q GROUP BY event_type"""
)
def acc_crps_transformed(spark, sf):
    fc = lc.forecast(lc.model(_train(spark, sf), m=M.DRIFT("log(value)")), H)
    return rounded(acc.accuracy(fc, events_daily(spark, sf), {"CRPS": ms.with_args(ms.CRPS, n_quantiles=99)}, period=7), "CRPS")


@query(_feat_sql("count(quantity) AS quantity_n, round(avg(quantity), 4) AS quantity_mean, round(stddev_samp(quantity), 4) AS quantity_sd, min(quantity) AS quantity_min, max(quantity) AS quantity_max"))
def feat_if_double(spark, sf):
    return rounded(feat.features_if(_shipped(spark, sf), lambda f: f.dataType.typeName() == "double", [feat.basic]), "quantity_mean", "quantity_sd")


@query(f"WITH {EV} SELECT event_type, day, round((ln(value) + ln(value + n)) / 2, 4) AS mu, round((ln(value + n) - ln(value)) / 2 / {_Z[95]}, 4) AS sigma FROM ev WHERE value > 0")
def dist_from_interval_log(spark, sf):
    df = events_daily(spark, sf).df.filter("value > 0").select("event_type", "day", F.col("value").alias("lo"), (F.col("value") + F.col("n")).alias("hi"))
    return rounded(from_interval(df, "lo", "hi", 95, 0), "mu", "sigma").select("event_type", "day", "mu", "sigma")
