"""Registered queries: ledger, valuation, logs, calendars, models, registries, each with its DuckDB form."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sketches, stats
from ..operators import calendar as C
from ..operators import ledger as L
from ..operators import models as M
from ..operators import series as S
from ..operators import valuation as P
from . import views as V
from .core_queries import K, exact, exact_sql, r6
from .metrics import Graph, Registry, before, return_graph
from .views import DAY, sql

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, run, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered already")
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


PID = "portfolio_id"
MID = 883_612_800_000  # 1998-01-01
_at = lambda t: f"t_ms <= {t}"

# Ledger.
#: The history of a portfolio is worked off in pieces of so many days; that of one asset in a portfolio only where it is long.
PIECE = 365 * DAY
_POS = sql("pos", "SELECT portfolio_id, ticker, t_ms, id, round(held, 4) + 0.0 AS held, round(position, 4) + 0.0 AS position FROM pos")


def _positions(piece):
    return lambda spark, d: r6(L.positions(V.txns(spark, d), piece).select(PID, "ticker", "t_ms", "id", "held", "position"), "held", "position", n=4)


add("ledger_positions", _positions(None), _POS)
add("ledger_positions_in_pieces", _positions(PIECE), _POS)
add("ledger_cash", lambda spark, d: r6(L.cash(V.txns(spark, d), PIECE).select(PID, "currency", "t_ms", "id", "delta", "balance"), "delta", "balance", n=2), sql("cd", "SELECT portfolio_id, currency, t_ms, id, round(delta, 2) + 0.0 AS delta, round(CAST(sum(CAST(delta AS DECIMAL(28,4))) OVER (PARTITION BY portfolio_id, currency ORDER BY t_ms, pr, id ROWS UNBOUNDED PRECEDING) AS DOUBLE), 2) + 0.0 AS balance FROM cd"))
_STRICT = """o AS (SELECT portfolio_id, ticker, type, id, quantity, row_number() OVER (PARTITION BY portfolio_id, ticker ORDER BY t_ms, pr, id) AS n FROM tp WHERE type NOT IN ('Deposit', 'Withdrawal')),
f AS (SELECT DISTINCT portfolio_id, ticker, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS q, false AS ever, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS reason FROM o
UNION ALL SELECT o.portfolio_id, o.ticker, o.n, CASE WHEN o.type = 'Buy' THEN q + o.quantity WHEN o.type = 'Sell' AND ever AND q >= o.quantity THEN q - o.quantity WHEN o.type = 'Split' THEN q * o.quantity ELSE q END, ever OR o.type = 'Buy', o.id,
CASE WHEN o.type = 'Sell' AND NOT (ever AND q >= o.quantity) THEN 'oversell' WHEN o.type IN ('Dividend', 'Split') AND NOT ever THEN 'no position' END
FROM f JOIN o ON o.portfolio_id = f.portfolio_id AND o.ticker = f.ticker AND o.n = f.n + 1)"""
add("ledger_violations", lambda spark, d: L.violations(V.txns(spark, d)), sql("tp", "SELECT portfolio_id, id, reason FROM f WHERE reason IS NOT NULL").replace("WITH", "WITH RECURSIVE", 1).replace("\nSELECT", f",\n{_STRICT}\nSELECT", 1))
add("txn_order", lambda spark, d: L.ordered(V.txns(spark, d), PIECE).select(PID, "id", "place"), sql("tp", "SELECT portfolio_id, id, row_number() OVER (PARTITION BY portfolio_id ORDER BY t_ms, pr, id) AS place FROM tp"))
add("txn_priority", lambda spark, d: V.txns(spark, d).groupBy("type", L.priority(F.col("type")).alias("priority")).agg(F.count("*").alias("n")), sql("tp", "SELECT type, pr AS priority, count(*) AS n FROM tp GROUP BY 1, 2"))
add("snapshot_make", lambda spark, d: r6(L.holdings(V.txns(spark, d)).where(_at(MID)).groupBy(PID, "asset").agg(F.max_by("quantity", "t_ms").alias("quantity")), "quantity", n=2), sql("hold", f"SELECT portfolio_id, asset, round(arg_max(quantity, t_ms), 2) + 0.0 AS quantity FROM hold WHERE {_at(MID)} GROUP BY 1, 2"))
add("portfolio_build", lambda spark, d: r6(L.holdings(V.txns(spark, d)).groupBy(PID, "asset").agg(F.max_by("quantity", "t_ms").alias("quantity")), "quantity", n=2), sql("hold", "SELECT portfolio_id, asset, round(arg_max(quantity, t_ms), 2) + 0.0 AS quantity FROM hold GROUP BY 1, 2"))


def _snapshots(spark, d):
    """Instants at which a portfolio has a snapshot, with the number of holdings that changed."""
    return L.holdings(V.txns(spark, d)).groupBy(PID, "t_ms").agg(F.count("*").alias("n_changed"))


_SNAP = "SELECT portfolio_id, t_ms, count(*) AS n_changed FROM hold GROUP BY 1, 2"
add("snapshot_closest", lambda spark, d: _snapshots(spark, d).where(_at(MID)).groupBy(PID).agg(F.max("t_ms").alias("t_ms"), F.max_by("n_changed", "t_ms").alias("n_changed")), sql("hold", f"SELECT portfolio_id, max(t_ms) AS t_ms, arg_max(n_changed, t_ms) AS n_changed FROM ({_SNAP}) WHERE {_at(MID)} GROUP BY 1"))
for _n in ("snapshot_latest", "latest_snapshot"):
    add(_n, lambda spark, d: _snapshots(spark, d).groupBy(PID).agg(F.max("t_ms").alias("t_ms"), F.max_by("n_changed", "t_ms").alias("n_changed")), sql("hold", f"SELECT portfolio_id, max(t_ms) AS t_ms, arg_max(n_changed, t_ms) AS n_changed FROM ({_SNAP}) GROUP BY 1"))
add("snapshots_covering", lambda spark, d: _snapshots(spark, d).withColumn("until", F.lead("t_ms").over(W.partitionBy(PID).orderBy("t_ms"))).where(f"t_ms <= {MID + 30 * DAY} AND (until > {MID} OR until IS NULL)").select(PID, "t_ms", "n_changed"), sql("hold", f"SELECT portfolio_id, t_ms, n_changed FROM (SELECT *, lead(t_ms) OVER (PARTITION BY portfolio_id ORDER BY t_ms) AS u FROM ({_SNAP})) WHERE t_ms <= {MID + 30 * DAY} AND (u > {MID} OR u IS NULL)"))
add("portfolio_list", lambda spark, d: V.txns(spark, d).select(PID).distinct(), sql("txn", "SELECT DISTINCT portfolio_id FROM txn"))
add("portfolio_soft_delete", lambda spark, d: V.txns(spark, d).select(PID).distinct().withColumn("deleted", F.col(PID) % 5 == 0).where("NOT deleted").select(PID), sql("txn", "SELECT DISTINCT portfolio_id FROM txn WHERE portfolio_id % 5 <> 0"))
add("portfolio_create", lambda spark, d: V.table(spark, d, "nation").select(F.col("n_nationkey").alias(PID)).join(V.txns(spark, d).where(F.col(PID) < 20), PID, "left_anti").select(PID, F.lit(MID - 1).alias("t_ms")), sql("txn", f"SELECT n_nationkey AS portfolio_id, CAST({MID - 1} AS BIGINT) AS t_ms FROM nation WHERE n_nationkey NOT IN (SELECT portfolio_id FROM txn WHERE portfolio_id < 20)"))

# Transaction log.
_half = lambda t, k: t.where(F.pmod(F.length("id"), F.lit(2)) == k)
add("txn_scan", lambda spark, d: V.txns(spark, d).where(F.col("t_ms") >= MID).select(PID, "id", "t_ms"), sql("txn", f"SELECT portfolio_id, id, t_ms FROM txn WHERE t_ms >= {MID}"))
add("enum_validate", lambda spark, d: V.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).join(F.broadcast(spark.createDataFrame([(k, v) for k, v in V.PRIORITIES.items() if v != "GBP"], "o_orderpriority string, currency string")), "o_orderpriority", "left").select("o_orderpriority", "n", "currency", F.col("currency").isNotNull().alias("valid")), "SELECT o_orderpriority, count(*) AS n, " + V._PRIO.replace("'GBP'", "NULL") + " AS currency, o_orderpriority <> '5-LOW' AS valid FROM orders GROUP BY 1")
add("asset_list", lambda spark, d: V.denomination(spark, d).select("asset").distinct(), sql("den", "SELECT DISTINCT asset FROM den"))
add("asset_save", lambda spark, d: V.denomination(spark, d).withColumn("v", F.lit(0)).unionByName(V.denomination(spark, d).where("currency = 'EUR'").withColumn("currency", F.lit("CHF")).withColumn("v", F.lit(1))).groupBy("asset").agg(F.max_by("currency", "v").alias("currency")), sql("den", "SELECT asset, CASE WHEN currency = 'EUR' THEN 'CHF' ELSE currency END AS currency FROM den"))
add("asset_lookup", lambda spark, d: V.txns(spark, d).select(F.coalesce("ticker", F.concat("currency", F.lit("-cash"))).alias("asset")).distinct().join(V.denomination(spark, d).where("currency <> 'JPY'"), "asset", "left").select("asset", F.coalesce("currency", F.when(F.col("asset").endswith("-cash"), F.substring("asset", 1, 3)), F.lit("unknown")).alias("currency")), sql("txn den", "SELECT a.asset, coalesce(den.currency, CASE WHEN a.asset LIKE '%-cash' THEN substr(a.asset, 1, 3) END, 'unknown') AS currency FROM (SELECT DISTINCT coalesce(ticker, currency || '-cash') AS asset FROM txn) a LEFT JOIN den ON a.asset = den.asset AND den.currency <> 'JPY'"))
_pairs = lambda spark, d: V.denomination(spark, d).select(F.col("currency").alias("base")).distinct().withColumn("quote", F.lit("USD"))
add("fx_pair_resolve", lambda spark, d: _pairs(spark, d).withColumn("own", F.when(F.col("base") == "EUR", F.lit("EUR_FIX"))).select("base", "quote", F.coalesce("own", F.concat("base", "quote", F.lit("=X"))).alias("series_id")), sql("den", "SELECT DISTINCT currency AS base, 'USD' AS quote, CASE WHEN currency = 'EUR' THEN 'EUR_FIX' ELSE currency || 'USD=X' END AS series_id FROM den"))
add("fx_pair_upsert", lambda spark, d: _pairs(spark, d).select("base", "quote", F.lit("v1").alias("series_id"), F.lit(1).alias("v")).unionByName(_pairs(spark, d).where("base < 'F'").select("base", "quote", F.lit("v2").alias("series_id"), F.lit(2).alias("v"))).groupBy("base", "quote").agg(F.max_by("series_id", "v").alias("series_id")), sql("den", "SELECT DISTINCT currency AS base, 'USD' AS quote, CASE WHEN currency < 'F' THEN 'v2' ELSE 'v1' END AS series_id FROM den"))


# Valuation on a 30-day grid.
def _values(spark, d):
    return P.value_weights(L.holdings(V.txns(spark, d)), V.prices(spark, d), V.fx(spark, d), V.denomination(spark, d), V.GRID)


def values_at(spark, d, at: int):
    return P.value_at(L.holdings(V.txns(spark, d)), V.prices(spark, d), V.fx(spark, d), V.denomination(spark, d), at)


def _gridded(view, spark, d):
    return P.on_grid(view(spark, d), V.GRID, [K], "value", None)


def _grid_of(view):
    return lambda spark, d: r6(_gridded(view, spark, d), "value")


add("price_on_grid", _grid_of(V.prices), sql("pg", "SELECT series_id, t_ms, round(value, 6) AS value FROM pg"))
add("fx_on_grid", _grid_of(V.fx), sql("fg", "SELECT series_id, t_ms, round(value, 6) AS value FROM fg"))
for _n, _view, _cte in (("price_at", V.prices, "p"), ("fx_at", V.fx, "fx")):
    add(_n, lambda spark, d, v=_view: r6(v(spark, d).where(_at(MID)).groupBy(K).agg(F.max_by("value", "t_ms").alias("value")), "value"), sql(_cte, f"SELECT series_id, round(arg_max(value, t_ms), 6) AS value FROM {_cte} WHERE {_at(MID)} GROUP BY 1"))


def _price_in_base(spark, d):
    price, rate = _gridded(V.prices, spark, d), _gridded(V.fx, spark, d).select(F.col(K).alias("currency"), "t_ms", F.col("value").alias("rate"))
    return price.join(V.denomination(spark, d), F.col(K) == F.col("asset")).join(rate, ["currency", "t_ms"], "left").select(K, "t_ms", (F.col("value") * F.coalesce("rate", F.lit(1.0))).alias("value")).select(K, "t_ms", exact("value", 2, "value"))


add("price_in_base", _price_in_base, sql("pg fg den", f"SELECT pg.series_id, pg.t_ms, {exact_sql('pg.value * coalesce(fg.value, 1)')} AS value FROM pg JOIN den ON pg.series_id = asset LEFT JOIN fg ON fg.series_id = den.currency AND fg.t_ms = pg.t_ms"))
_VW = f"SELECT portfolio_id, t_ms, asset, {exact_sql('value')} AS value, {exact_sql('total')} AS total, round(CASE WHEN total = 0 THEN 0 ELSE value / total END, 5) + 0.0 AS weight FROM vw"
add("value_weight_series", lambda spark, d: r6(_values(spark, d).select(PID, "t_ms", "asset", exact("value", 2, "value"), exact("total", 2, "total"), "weight"), "weight", n=5), sql("vw", _VW))
add("weights_series", lambda spark, d: r6(_values(spark, d).select(PID, "t_ms", "asset", "weight"), "weight", n=5), sql("vw", f"SELECT portfolio_id, t_ms, asset, weight FROM ({_VW})"))
add("value_series", lambda spark, d: _values(spark, d).groupBy(PID, "t_ms").agg(F.sum(F.col("value").cast(L.MONEY)).alias("value")).select(PID, "t_ms", exact("value", 2, "value")), sql("val", f"SELECT portfolio_id, t_ms, {exact_sql('sum(CAST(value AS DECIMAL(28,4)))')} AS value FROM val GROUP BY 1, 2"))
add("quantity_series", lambda spark, d: r6(P.on_grid(L.holdings(V.txns(spark, d)), V.GRID, [PID, "asset"], "quantity"), "quantity", n=2), sql("hg", "SELECT portfolio_id, asset, t_ms, round(quantity, 2) + 0.0 AS quantity FROM hg"))
_AT = V.GRID[0] + 40 * V.GRID[2]
add("overview_at", lambda spark, d: r6(r6(values_at(spark, d, _AT).select(PID, "asset", F.when(F.col("total") <= 0, 0.0).otherwise(F.col("total")).alias("total"), F.when(F.col("total") > 0, F.col("weight")).alias("weight")), "total", n=2), "weight", n=5), sql("vw", f"SELECT portfolio_id, asset, round(greatest(total, 0), 2) + 0.0 AS total, round(CASE WHEN total > 0 THEN value / total END, 5) + 0.0 AS weight FROM vw WHERE t_ms = {_AT}"))
add("weights_sum_check", lambda spark, d: _values(spark, d).groupBy(PID, "t_ms").agg(F.sum("weight").alias("w"), F.max("total").alias("total")).where("total <> 0").groupBy(PID).agg(F.count("*").alias("n_ticks"), (F.max(F.abs(F.col("w") - 1)) < 1e-6).alias("sums_to_one")), sql("vw", "SELECT portfolio_id, count(DISTINCT t_ms) AS n_ticks, true AS sums_to_one FROM vw WHERE total <> 0 GROUP BY 1"))
_wts = lambda spark, d: V.txns(spark, d).where("type = 'Buy'").groupBy(PID, F.col("ticker").alias(K)).agg(F.count("*").cast("double").alias("weight"))


def _nav(quantity):
    def run(spark, d):
        return P.nav(_gridded(V.prices, spark, d), _wts(spark, d), quantity).select(PID, "t_ms", exact("nav", 2 if quantity else 4, "nav"))

    return run


_WT = "wt AS (SELECT portfolio_id, ticker AS series_id, CAST(count(*) AS DOUBLE) AS weight FROM txn WHERE type = 'Buy' GROUP BY 1, 2), pf AS (SELECT series_id, arg_min(value, t_ms) AS p0 FROM pg GROUP BY 1), tw AS (SELECT portfolio_id, sum(weight) AS t FROM wt GROUP BY 1)"
_with = lambda q, extra: q.replace("\nSELECT", f",\n{extra}\nSELECT", 1)
add("nav_target_weighted", _nav(False), _with(sql("pg txn", f"SELECT portfolio_id, t_ms, {exact_sql('sum(weight / t * value / p0)', 4)} AS nav FROM wt JOIN tw USING (portfolio_id) JOIN pg USING (series_id) JOIN pf USING (series_id) GROUP BY 1, 2"), _WT))
add("nav_quantity_based", _nav(True), _with(sql("pg txn", f"SELECT portfolio_id, t_ms, {exact_sql('sum(weight * value)')} AS nav FROM wt JOIN pg USING (series_id) GROUP BY 1, 2"), _WT))
add("target_allocations", lambda spark, d: r6(_wts(spark, d).withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy(PID))), "weight"), _with(sql("pg txn", "SELECT portfolio_id, series_id, round(weight / t, 6) AS weight FROM wt JOIN tw USING (portfolio_id)"), _WT))
add("universe_filter", lambda spark, d: V.txns(spark, d).join(V.denomination(spark, d).where("currency IN ('USD', 'EUR')").select(F.col("asset").alias("ticker")), "ticker", "left_semi").groupBy(PID).agg(F.count("*").alias("n")), sql("txn den", "SELECT portfolio_id, count(*) AS n FROM txn WHERE ticker IN (SELECT asset FROM den WHERE currency IN ('USD', 'EUR')) GROUP BY 1"))


def _grid_rows(spark, d, rates_only: bool = False):
    """Ticks of every asset that a portfolio ever held and of the rate of every currency but the base, USD, of its holdings and cash."""
    held = L.holdings(V.txns(spark, d)).groupBy(PID, "asset").agg(F.max(F.col("quantity") != 0).alias("ever")).where("ever").select(PID, "asset")
    # Cash has no brand: as null it is safe where the join's filters reach this side.
    shares = held.select(PID, F.when(~F.col("asset").startswith("CASH:"), F.col("asset")).alias("asset"))
    own = shares.join(V.denomination(spark, d), "asset").select(PID, "currency")
    cash = held.where("asset LIKE 'CASH:%'").select(PID, F.substring("asset", 6, 99).alias("currency"))
    wanted = own.unionByName(cash).where("currency <> 'USD'").distinct().withColumnRenamed("currency", K)
    ticks = lambda keys, series: keys.join(series.select(K, "t_ms"), K).select(PID, K, "t_ms")
    rates = ticks(wanted, V.fx(spark, d))
    return rates if rates_only else ticks(shares.withColumnRenamed("asset", K), V.prices(spark, d)).unionByName(rates)


def _grid_all(spark, d):
    return _grid_rows(spark, d).select(PID, "t_ms").distinct()


def _grid_common(spark, d):
    """Ticks that all rates of a portfolio have: with the prices of all its assets there would be none."""
    rows = _grid_rows(spark, d, rates_only=True).distinct()
    wanted = rows.groupBy(PID).agg(F.countDistinct(K).alias("n"))
    return rows.groupBy(PID, "t_ms").agg(F.count("*").alias("held")).join(wanted, PID).where("held = n").select(PID, "t_ms")


# Calendars. Days leave as text, which both engines write alike.
def add_days(name, run, oracle, *days):
    add(name, lambda spark, d: run(spark, d).withColumns({c: F.col(c).cast("string") for c in days}), "SELECT * REPLACE (" + ", ".join(f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in days) + f") FROM ({oracle})")


_A, _B = "1995-01-01", "2001-12-31"
add_days("trading_day_weekday", lambda spark, d: V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("open", C.is_weekday(F.col("day"))), "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, isodow(o_orderdate) < 6 AS open FROM orders", "day")
add_days("trading_day_holiday", lambda spark, d: C.trading_days(spark, _A, _B, V.holidays(spark, d)), sql("td", "SELECT day FROM td"), "day")
_FORMS = {"unadjusted": "day", "following": "following", "preceding": "preceding", "modified_following": "CASE WHEN date_trunc('month', following) = date_trunc('month', day) THEN following ELSE preceding END", "modified_preceding": "CASE WHEN date_trunc('month', preceding) = date_trunc('month', day) THEN preceding ELSE following END"}
add("periods_per_year", lambda spark, d: C.trading_days(spark, _A, _B, V.holidays(spark, d)).groupBy(F.year("day").alias("year")).agg(F.round(F.count("*") / (365 * 86_400_000 / C.YEAR_MS), 4).alias("periods")), sql("td", "SELECT CAST(year(day) AS INT) AS year, round(count(*) / (365 / 365.2425), 4) AS periods FROM td GROUP BY 1"))


def _rules(spark, d):
    o = V.table(spark, d, "orders").where("o_orderkey IS NOT NULL").select("o_orderkey", F.to_date("o_orderdate").alias("start"))
    unit = F.get(F.array(*[F.lit(x) for x in ("day", "week", "month", "quarter", "year")]), (F.col("o_orderkey") % 5).cast("int"))
    return o.select("o_orderkey", "start", F.add_months("start", 18).alias("end"), unit.alias("unit"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("step"))


_REC = """r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS st, CAST(CAST(o_orderdate AS DATE) + INTERVAL 18 MONTH AS DATE) AS en, o_orderkey % 5 AS u, o_orderkey % 3 + 1 AS sp FROM orders),
rc AS (SELECT o_orderkey, CAST(CASE u WHEN 0 THEN st + to_days(CAST(k * sp AS INT)) WHEN 1 THEN st + to_days(CAST(k * sp * 7 AS INT)) WHEN 2 THEN st + to_months(CAST(k * sp AS INT)) WHEN 3 THEN st + to_months(CAST(k * sp * 3 AS INT)) ELSE st + to_months(CAST(k * sp * 12 AS INT)) END AS DATE) AS day, en FROM r, range(600) x(k))"""


def _calendar(spark, d, months: int = 0):
    """The roll table of every day from the first order to ``months`` after the last, looked up in a calendar a month longer on both sides.

    Holidays are New Year's Day and the weekdays between the first and the last order without an order.
    """
    days = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).where("day IS NOT NULL").distinct()
    first, last, end = days.agg(F.min("day"), F.max("day"), F.add_months(F.max("day"), months)).first()
    begin, until = first - timedelta(31), end + timedelta(31)
    every = spark.range(1).select(F.explode(F.sequence(F.lit(begin), F.lit(until))).alias("day"))
    inside = every.where(F.col("day").between(first, last)).join(days, "day", "left_anti")
    holidays = inside.unionByName(every.where("month(day) = 1 AND day(day) = 1"))
    return C.roll_table(spark, str(begin), str(until), holidays).where(F.col("day").between(first, end))


_ev = lambda spark, d: V.txns(spark, d).where("type IN ('Dividend', 'Split')").select("ticker", "t_ms", F.col("type").alias("kind"), F.when(F.col("type") == "Split", F.col("quantity")).otherwise(F.col("price")).alias("amount_per_unit"), "currency", "id", PID)
add("events_in_range", lambda spark, d: _ev(spark, d).where(f"t_ms BETWEEN {MID} AND {MID + 365 * DAY}").select(PID, "ticker", "t_ms", "kind", "id"), sql("txn", f"SELECT portfolio_id, ticker, t_ms, type AS kind, id FROM txn WHERE type IN ('Dividend', 'Split') AND t_ms BETWEEN {MID} AND {MID + 365 * DAY}"))
add("events_to_transactions", lambda spark, d: r6(C.events_to_transactions(_ev(spark, d)), "price"), sql("txn", "SELECT ticker, t_ms, type, CASE WHEN type = 'Split' THEN quantity ELSE 0 END AS quantity, round(price, 6) AS price, currency FROM txn WHERE type IN ('Dividend', 'Split')"))

# Models of the hourly means of each event type.
add("train_split", lambda spark, d: M.split(V.by_type(spark, d)).groupBy(K, "part").agg(F.count("*").alias("n")), sql("st", "SELECT series_id, part, count(*) AS n FROM (SELECT series_id, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS part FROM (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t_ms) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM st)) GROUP BY 1, 2"))
_L1 = "x AS (SELECT series_id, t_ms, value AS y, lag(value) OVER (PARTITION BY series_id ORDER BY t_ms) AS x1 FROM st), b AS (SELECT series_id, regr_slope(y, x1) AS phi, regr_intercept(y, x1) AS c, count(*) AS n FROM x WHERE x1 IS NOT NULL GROUP BY 1), pd AS (SELECT x.series_id, t_ms, y AS actual, c + phi * x1 AS predicted FROM x JOIN b USING (series_id) WHERE x1 IS NOT NULL)"
_m1 = lambda body: _with(sql("st", body), _L1)
_fit = lambda spark, d, q=1: M.fit_ols(V.by_type(spark, d), q)
add("ar_fit_ols", lambda spark, d: _fit(spark, d).select(K, (F.round("c", 5) + 0.0).alias("c"), (F.round(F.col("phi")[0], 6) + 0.0).alias("phi"), "n"), _m1("SELECT series_id, round(c, 5) + 0.0 AS c, round(phi, 6) + 0.0 AS phi, n FROM b"))
add("ar_fit_ols_q3", lambda spark, d: _fit(spark, d, 3).select(K, "c", "phi", "n"))
_RAT = "0.17087277"
for _x in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223"):
    _RAT = f"({_x} + u * {_RAT})"
_PV = lambda t: f"u * exp({_RAT} - (({t}) / sqrt(2)) ** 2)"
_DIAG = f"""dg AS (SELECT series_id, any_value(b.c) AS c, any_value(b.phi) AS phi, sqrt(sum((actual - predicted) ** 2) / (count(*) - 2)) AS sigma, any_value(sxx) AS sxx, any_value(mx) AS mx, count(*) AS n FROM pd JOIN b USING (series_id) JOIN (SELECT series_id, regr_sxx(y, x1) AS sxx, avg(x1) AS mx FROM x WHERE x1 IS NOT NULL GROUP BY 1) USING (series_id) GROUP BY 1),
de AS (SELECT *, sigma * sqrt(1 / n + mx * mx / sxx) AS se_c, sigma / sqrt(sxx) AS se_phi, -sigma * sigma * mx / sxx AS cov FROM dg),
dt AS (SELECT *, c / se_c AS t_c, phi / se_phi AS t_phi FROM de)"""
_SIX = ["sigma", "se_c", "se_phi", "cov", "t_c", "t_phi", "p_c", "p_phi"]
add("ar_diagnostics", lambda spark, d: r6(_fit(spark, d).select(K, "sigma", F.col("std_errors")[0].alias("se_c"), F.col("std_errors")[1].alias("se_phi"), F.col("covariance")[0][1].alias("cov"), F.col("t")[0].alias("t_c"), F.col("t")[1].alias("t_phi"), F.col("p")[0].alias("p_c"), F.col("p")[1].alias("p_phi")), *_SIX, n=4), _with(_m1("SELECT series_id, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in _SIX) + f" FROM (SELECT *, (SELECT {_PV('t_c')} FROM (SELECT 1 / (1 + abs(t_c) / sqrt(2) / 2) AS u)) AS p_c, (SELECT {_PV('t_phi')} FROM (SELECT 1 / (1 + abs(t_phi) / sqrt(2) / 2) AS u)) AS p_phi FROM dt)"), _DIAG))
add("ar_stationary", lambda spark, d: _fit(spark, d).select(K, "stationary"), _m1("SELECT series_id, abs(phi) < 1 AS stationary FROM b"))
_YW = """zz AS (SELECT series_id, t_ms, value - avg(value) OVER (PARTITION BY series_id) AS z, avg(value) OVER (PARTITION BY series_id) AS m FROM st),
zl AS (SELECT series_id, m, z, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2 FROM zz WINDOW w AS (PARTITION BY series_id ORDER BY t_ms)),
gm AS (SELECT series_id, any_value(m) AS m, count(*) AS n, sum(z * z) AS g0, sum(z * z1) AS g1, sum(z * z2) AS g2 FROM zl GROUP BY 1),
yw AS (SELECT series_id, m, n, g0, g1, g2, 1 AS "order", g1 / g0 AS a, CAST(NULL AS DOUBLE) AS b FROM gm UNION ALL SELECT series_id, m, n, g0, g1, g2, 2, g1 * (g0 - g2) / (g0 * g0 - g1 * g1), (g0 * g2 - g1 * g1) / (g0 * g0 - g1 * g1) FROM gm),
ys AS (SELECT *, (1 - a - coalesce(b, 0)) * m AS c, (g0 - a * g1 - coalesce(b * g2, 0)) / n AS sigma2 FROM yw),
ya AS (SELECT *, n * ln(sigma2) + 2 * ("order" + 1) AS aic FROM ys)"""
add("ar_fit_yule_walker", lambda spark, d: r6(stats.yule_walker(V.by_type(spark, d), 2).select(K, "order", "c", F.col("phi")[0].alias("phi1"), F.get("phi", F.lit(1)).alias("phi2"), "sigma2", "aic", "chosen"), "c", "phi1", "phi2", "sigma2", "aic", n=5), _with(sql("st", "SELECT series_id, CAST(\"order\" AS INT) AS \"order\", round(c, 5) + 0.0 AS c, round(a, 5) + 0.0 AS phi1, round(b, 5) + 0.0 AS phi2, round(sigma2, 5) + 0.0 AS sigma2, round(aic, 5) + 0.0 AS aic, \"order\" = arg_min(\"order\", (aic, \"order\")) OVER (PARTITION BY series_id) AS chosen FROM ya"), _YW))
add("ar_predict", lambda spark, d: r6(M.predict(V.by_type(spark, d), _fit(spark, d), 1).drop("sigma"), "actual", "predicted", n=5), _m1("SELECT series_id, t_ms, round(actual, 5) AS actual, round(predicted, 5) AS predicted FROM pd"))
_EV = ["mse", "rmse", "mae", "r2", "adj_r2", "log_likelihood", "aic"]
add("ar_evaluate", lambda spark, d: r6(M.evaluate(M.predict(V.by_type(spark, d), _fit(spark, d), 1), 1).select(K, "n", *_EV), *_EV, n=4), _with(_m1("SELECT series_id, n, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in _EV) + " FROM (SELECT *, sqrt(mse) AS rmse, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, 6 - 2 * log_likelihood AS aic FROM (SELECT *, -n / 2.0 * ln(2 * pi() * sse / (n - 2)) - (n - 2) / 2.0 AS log_likelihood FROM ev))"), "ev AS (SELECT series_id, count(*) AS n, sum((actual - predicted) ** 2) AS sse, avg((actual - predicted) ** 2) AS mse, avg(abs(actual - predicted)) AS mae, 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2 FROM pd GROUP BY 1)"))
add("ar_forecast", lambda spark, d: r6(M.forecast(V.by_type(spark, d), _fit(spark, d), 1, 3), "predicted", n=5), _m1("SELECT series_id, t0 + k * dt AS t_ms, round(CASE k WHEN 1 THEN c + phi * v WHEN 2 THEN c + phi * (c + phi * v) ELSE c + phi * (c + phi * (c + phi * v)) END, 5) AS predicted FROM (SELECT series_id, max(t_ms) AS t0, arg_max(value, t_ms) AS v, max(t_ms) - list_sort(list(t_ms), 'DESC')[2] AS dt FROM st GROUP BY 1) JOIN b USING (series_id), range(1, 4) q(k)"))


# Registries.
def _registry() -> Registry:
    r = Registry()
    r.add_metric("mean", lambda: F.round(stats.mean("value"), 4))
    r.add_metric("above", lambda x=10.0: F.count_if(F.col("value") > x))
    r.add_metric("gone", lambda: F.max("value"))
    r.remove_metric("gone")
    return r


_UM = sql("s", "SELECT series_id, round(avg(value), 4) AS mean, count(*) FILTER (value > 10) AS above FROM s GROUP BY 1")
for _n in ("udaf_metric", "metric_remove"):
    add(_n, lambda spark, d: _registry().evaluate(V.series(spark, d), [K]), _UM)
add("udaf_metric_param", lambda spark, d: _registry().evaluate(V.series(spark, d), [K], {"above": {"x": 20.0}}), _UM.replace("value > 10", "value > 20"))
add("udaf_metric_multi", lambda spark, d: _registry().evaluate_multi(V.by_type(spark, d), ["click", "view"], K, lambda c: F.round(F.sum(c[0]) + F.sum(c[1]), 3), "total"), sql("st", "SELECT round(sum(value) FILTER (series_id = 'click') + sum(value) FILTER (series_id = 'view'), 3) AS total FROM st WHERE series_id IN ('click', 'view')"))
add("udf_apply", lambda spark, d: r6(V.series(spark, d).withColumn("value", F.ln(F.col("value") + 1)), "value"), sql("s", "SELECT series_id, t_ms, round(ln(value + 1), 6) AS value FROM s"))


def _derived(spark, d):
    """A diamond: the sum of the base series and its double, and two returns of that sum."""
    g = Graph()
    g.transforms |= return_graph().transforms
    g.add("sum", ["base", "base::double"], lambda a, b: a + b)
    return r6(g.evaluate(V.series(spark, d), ["base::double", "sum::simple", "sum::log"]), "value")


_DER = "q AS (SELECT series_id, t_ms, value, value * 3 AS y, lag(value * 3) OVER (PARTITION BY series_id ORDER BY t_ms) AS b FROM s)"
add("derived_series", _derived, _with(sql("s", "SELECT series_id, 'base::double' AS item, t_ms, round(value * 2, 6) + 0.0 AS value FROM q UNION ALL SELECT series_id, 'sum::simple', t_ms, round((y - b) / b, 6) + 0.0 FROM q WHERE b > 0 AND y >= 0 UNION ALL SELECT series_id, 'sum::log', t_ms, round(ln(y / b), 6) + 0.0 FROM q WHERE b > 0 AND y > 0"), _DER))


def _installed(spark, d):
    """The default return features of every brand, with two more installed after them, one on the other."""
    g = return_graph()
    g.add("momentum", ["base"], lambda x: x / before(x, 5) - 1)
    g.install("momentum", "momentum::diff")
    return g.evaluate(V.prices(spark, d), []).withColumn("value", exact("value", 4))


_INST = "q AS (SELECT series_id, t_ms, value, lag(value) OVER w AS b, value / lag(value, 5) OVER w - 1 AS m FROM p WINDOW w AS (PARTITION BY series_id ORDER BY t_ms)), qm AS (SELECT *, m - lag(m) OVER (PARTITION BY series_id ORDER BY t_ms) AS dm FROM q), qa AS (SELECT series_id, 'base::log' AS item, t_ms, ln(value / b) AS value FROM qm WHERE b > 0 AND value > 0 UNION ALL SELECT series_id, 'base::simple', t_ms, (value - b) / b FROM qm WHERE b > 0 AND value >= 0 UNION ALL SELECT series_id, 'momentum', t_ms, m FROM qm UNION ALL SELECT series_id, 'momentum::diff', t_ms, dm FROM qm)"
add("feature_install", _installed, _with(sql("p", f"SELECT series_id, item, t_ms, {exact_sql('value', 4)} AS value FROM qa WHERE value IS NOT NULL"), _INST))
add("correlation_matrix_blocks", lambda spark, d: r6(stats.correlation_blocks(V.prices(spark, d), n_blocks=4), "corr"), sql("p", "SELECT x.series_id AS a, y.series_id AS b, round(corr(x.value, y.value), 6) + 0.0 AS corr FROM p x JOIN p y ON x.t_ms = y.t_ms AND x.series_id < y.series_id GROUP BY 1, 2 UNION ALL SELECT DISTINCT series_id, series_id, 1.0::DOUBLE FROM p"))


def _sketched(spark, d):
    """Whether the median and the 90 % quantile from merged daily sketches have a rank within twice the stated error, for each event type."""
    s = V.table(spark, d, "events").select(F.col("event_type").alias(K), V.ms("ts").alias("t_ms"), "value")
    asked = sketches.quantiles(sketches.merged(sketches.sketched(s, [K], DAY), [K]), [K], [0.5, 0.9]).withColumnRenamed("value", "q")
    ranks = s.join(F.broadcast(asked), K).groupBy(K, "share").agg(F.count("*").alias("n"), F.avg((F.col("value") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("upto"))
    allowed = 2 * sketches.rank_error()
    return ranks.select(K, "share", "n", ((F.col("below") <= F.col("share") + allowed) & (F.col("upto") >= F.col("share") - allowed)).alias("within"))


add("stat_quantile_sketch", _sketched, "SELECT event_type AS series_id, share, count(*) AS n, true AS within FROM events, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) v(share) GROUP BY 1, 2")
add("set_range", lambda spark, d: r6(S.returns(V.prices(spark, d).where(f"t_ms BETWEEN {MID} AND {MID + 365 * DAY}"), "simple"), "value"), sql("p", f"SELECT series_id, t_ms, round((value - b) / b, 6) + 0.0 AS value FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t_ms) AS b FROM p WHERE t_ms BETWEEN {MID} AND {MID + 365 * DAY}) WHERE b IS NOT NULL"))
add("analysis_describe", lambda spark, d: V.by_type(spark, d).groupBy(K).agg(F.round(stats.mean("value"), 4).alias("mean"), F.round(stats.std("value", False), 4).alias("sd"), (F.round(stats.skew("value"), 3) + 0.0).alias("skew"), (F.round(stats.kurtosis("value"), 3) + 0.0).alias("kurt"), F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max")).join(stats.acf(V.by_type(spark, d), 1).where("lag = 1").select(K, (F.round("acf", 5) + 0.0).alias("acf1")), K), _with(sql("st", "SELECT series_id, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / stddev_pop(value) ** 3, 3) + 0.0 AS skew, round(kurtosis_pop(value) + 3, 3) + 0.0 AS kurt, round(min(value), 4) AS min, round(max(value), 4) AS max, any_value(r) AS acf1 FROM st JOIN (SELECT series_id, round(sum(z * zl) / sum(z * z), 5) + 0.0 AS r FROM zz GROUP BY 1) USING (series_id) GROUP BY 1"), "zz AS (SELECT series_id, z, coalesce(lag(z) OVER (PARTITION BY series_id ORDER BY t_ms), 0) AS zl FROM (SELECT series_id, t_ms, value - avg(value) OVER (PARTITION BY series_id) AS z FROM st))"))
