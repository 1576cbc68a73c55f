"""Registered queries that put operators together: analyses of portfolios, refits of models, and calendars of instants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import models as M
from ..operators import valuation as P
from . import views as V
from .core_queries import K, exact, exact_sql, r6
from .portfolio_queries import MID, PID, _with, _wts, _WT, values_at
from .session_queries import _FEATURES, _FS, _shown, return_features
from .views import CTE, DAY, HOUR, sql

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, run, oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


# The newest tick of the valuation grid, valued alone.
_LAST = V.GRID[0] + (V.GRID[1] - V.GRID[0]) // V.GRID[2] * V.GRID[2]


def _valuation(spark, d) -> DataFrame:
    rows = values_at(spark, d, _LAST).where("quantity <> 0")
    return r6(rows.select(PID, "asset", exact("value", 2, "value"), exact("total", 2, "total"), "weight"), "weight", n=5)


add("portfolio_valuation", _valuation, sql("vw", f"SELECT portfolio_id, asset, {exact_sql('value')} AS value, {exact_sql('total')} AS total, round(CASE WHEN total = 0 THEN 0 ELSE value / total END, 5) + 0.0 AS weight FROM vw WHERE t_ms = {_LAST} AND quantity <> 0"))

# Portfolio analyses: the NAV of a range at a frequency, with the return series and metrics of it; a supplied NAV takes the place of the computed one.
RANGE = (MID - 730 * DAY, MID + 730 * DAY, 15 * DAY)


def computed_nav(spark, d, span) -> DataFrame:
    prices = P.on_grid(V.prices(spark, d), span, [K], "value", None)
    return P.nav(prices, _wts(spark, d)).select(PID, "t_ms", exact("nav", 4, "nav"))


def analysis(nav: DataFrame) -> DataFrame:
    """The return features of NAV series, by portfolio."""
    return return_features(nav.select(F.col(PID).alias(K), "t_ms", F.col("nav").alias("value"))).withColumnRenamed(K, PID)


def _supplied(spark, d) -> DataFrame:
    """Mean order totals by 90 days, as the NAV of every fourth portfolio."""
    quarter = F.floor(V.ms("o_orderdate") / (90 * DAY)) * (90 * DAY)
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer").where("c_nationkey % 4 = 3").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias(PID), quarter.alias("t_ms")).agg(exact(F.avg("o_totalprice"), 2, "nav"))


def _final(spark, d) -> DataFrame:
    return P.override(computed_nav(spark, d, RANGE), _supplied(spark, d))


_BASE = f"""gr AS (SELECT unnest(generate_series({RANGE[0]}, {RANGE[1]}, {RANGE[2]})) AS t_ms),
pgr AS ({CTE["pg"].replace("JOIN g ON", "JOIN gr ON").replace("g.t_ms", "gr.t_ms")}),
{_WT.replace("FROM pg", "FROM pgr")},
cn AS (SELECT portfolio_id, t_ms, {exact_sql('sum(weight / t * value / p0)', 4)} AS nav FROM wt JOIN tw USING (portfolio_id) JOIN pgr USING (series_id) JOIN pf USING (series_id) GROUP BY 1, 2),
su AS (SELECT c_nationkey AS portfolio_id, (epoch_us(o_orderdate) // 1000) // {90 * DAY} * {90 * DAY} AS t_ms, {exact_sql('avg(o_totalprice)')} AS nav FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 = 3 GROUP BY 1, 2),
fn AS (SELECT * FROM cn WHERE portfolio_id NOT IN (SELECT portfolio_id FROM su) UNION ALL SELECT * FROM su)"""
_of = lambda nav: _with(sql("p txn", _FS.replace("SELECT series_id", "SELECT series_id AS portfolio_id", 1)), f"{_BASE}, nv AS (SELECT portfolio_id AS series_id, t_ms, nav AS value FROM {nav}), {_FEATURES('nv')}")
add("portfolio_analysis", lambda spark, d: _shown(analysis(computed_nav(spark, d, RANGE))), _of("cn"))
add("nav_override", _final, _with(sql("p txn", "SELECT portfolio_id, t_ms, nav FROM fn"), _BASE))
add("nav_override_features", lambda spark, d: _shown(analysis(_final(spark, d))), _of("fn"))

# Models of the first three fifths of each event type's hourly means; those whose newest errors are too large are fitted anew on all of them.
LAST_N, LIMIT = 50, 1000.0


def _refit(spark, d) -> DataFrame:
    whole = V.by_type(spark, d)
    models = M.fit_ols(M.split(whole).where("part = 'train'").drop("part"), 1)
    out = M.refit(whole, models, 1, LAST_N, LIMIT).select(K, "c", F.col("phi")[0].alias("phi"), "rolling_mse", "refitted", F.col("context")[0].alias("context"))
    return r6(out, "c", "phi", "rolling_mse", "context", n=4)


_RE = f"""ta AS (SELECT series_id, t_ms, value AS y, lag(value) OVER w AS x1, row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY series_id) * 0.6) AS train FROM st WINDOW w AS (PARTITION BY series_id ORDER BY t_ms)),
od AS (SELECT series_id, regr_slope(y, x1) AS phi, regr_intercept(y, x1) AS c FROM ta WHERE train AND x1 IS NOT NULL GROUP BY 1),
ne AS (SELECT series_id, regr_slope(y, x1) AS phi, regr_intercept(y, x1) AS c, arg_max(y, t_ms) AS context FROM ta WHERE x1 IS NOT NULL GROUP BY 1),
er AS (SELECT series_id, avg((y - c - phi * x1) ** 2) AS mse FROM (SELECT series_id, y, x1, c, phi, row_number() OVER (PARTITION BY series_id ORDER BY t_ms DESC) AS k FROM ta JOIN od USING (series_id) WHERE x1 IS NOT NULL) WHERE k <= {LAST_N} GROUP BY 1)"""
add("ar_refit", _refit, _with(sql("st", f"SELECT series_id, round(CASE WHEN mse > {LIMIT} THEN ne.c ELSE od.c END, 4) + 0.0 AS c, round(CASE WHEN mse > {LIMIT} THEN ne.phi ELSE od.phi END, 4) + 0.0 AS phi, round(mse, 4) + 0.0 AS rolling_mse, mse > {LIMIT} AS refitted, round(context, 4) + 0.0 AS context FROM od JOIN ne USING (series_id) JOIN er USING (series_id)"), _RE))

# Calendars of instants: orders come at an hour given by their key, and are seen at an offset from UTC.
OFFSET = 9 * HOUR


def _closed(spark, d) -> DataFrame:
    """Holidays: the days between the first and the last order without one, and every New Year's Day nearby."""
    days = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).where("day IS NOT NULL").distinct()
    every = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select("a", "b", F.explode(F.sequence(F.date_sub("a", 31), F.date_add("b", 31))).alias("day"))
    return every.where("day BETWEEN a AND b").join(days, "day", "left_anti").select("day").unionByName(every.where("month(day) = 1 AND day(day) = 1").select("day"))


def _open_at(spark, d) -> DataFrame:
    hour = (F.col("o_orderkey") % 24) * HOUR
    instants = V.table(spark, d, "orders").select((V.ms("o_orderdate") + hour).alias("t_ms")).where("t_ms IS NOT NULL").distinct()
    return C.at_trading_days(instants, _closed(spark, d), OFFSET).select("t_ms", F.col("day").cast("string").alias("day"), "open")


_DAYS = "od AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), oe AS (SELECT min(day) AS f, max(day) AS l FROM od)"
add("trading_day_at", _open_at, f"WITH {_DAYS}, x AS (SELECT DISTINCT epoch_us(o_orderdate) // 1000 + (o_orderkey % 24) * {HOUR} AS t_ms FROM orders), y AS (SELECT t_ms, CAST(make_timestamp((t_ms + {OFFSET}) * 1000) AS DATE) AS day FROM x) SELECT t_ms, CAST(day AS VARCHAR) AS day, isodow(day) < 6 AND NOT (month(day) = 1 AND day(day) = 1) AND NOT (day BETWEEN f AND l AND day NOT IN (SELECT day FROM od)) AS open FROM y, oe")


def _recurring(spark, d) -> DataFrame:
    o = V.table(spark, d, "orders").where("o_orderkey IS NOT NULL AND o_orderdate IS NOT NULL")
    day, midnight = F.to_date("o_orderdate"), lambda x: F.unix_date(x).cast("long") * DAY
    unit = F.get(F.array(*[F.lit(x) for x in ("day", "week", "month", "quarter", "year")]), (F.col("o_orderkey") % 5).cast("int"))
    rules = o.select("o_orderkey", (midnight(day) + (F.col("o_orderkey") * 7919 % 86_400) * 1000).alias("start_ms"), (midnight(F.add_months(day, 18)) + 12 * HOUR).alias("end_ms"), unit.alias("unit"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("step"))
    return C.recurrence_at(rules).select("o_orderkey", "t_ms")


add("recurrence_at", _recurring, """WITH r AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds(CAST(o_orderkey * 7919 % 86400 AS INT)) AS st, CAST(CAST(o_orderdate AS DATE) + INTERVAL 18 MONTH AS TIMESTAMP) + INTERVAL 12 HOUR AS en, o_orderkey % 5 AS u, o_orderkey % 3 + 1 AS sp FROM orders),
rc AS (SELECT o_orderkey, CASE u WHEN 0 THEN st + to_days(CAST(k * sp AS INT)) WHEN 1 THEN st + to_days(CAST(k * sp * 7 AS INT)) WHEN 2 THEN st + to_months(CAST(k * sp AS INT)) WHEN 3 THEN st + to_months(CAST(k * sp * 3 AS INT)) ELSE st + to_months(CAST(k * sp * 12 AS INT)) END AS t, en FROM r, range(600) x(k))
SELECT o_orderkey, epoch_us(t) // 1000 AS t_ms FROM rc WHERE t <= en""")
