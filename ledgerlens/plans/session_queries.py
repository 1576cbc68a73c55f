"""Registered queries over bucketed series, return features, loading from snapshots, and whole calendars, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import buckets as B
from ..operators import calendar as C
from ..operators import ledger as L
from ..operators import series as S
from . import portfolio_queries as PQ
from . import views as V
from .core_queries import K, _requests, _RQ, exact, exact_sql, r6
from .portfolio_queries import MID, PID, _FORMS, _REC, _calendar, _rules, _with
from .views import DAY, HOUR, sql

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, run, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered already")
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def add_days(name, run, oracle, *days):
    add(name, lambda spark, d: run(spark, d).withColumns({c: F.col(c).cast("string") for c in days}), "SELECT * REPLACE (" + ", ".join(f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in days) + f") FROM ({oracle})")


# Grids served from the bucket that fits them.
_COV = "cov AS (SELECT series_id, freq_ms, min(t_ms) AS lo, max(t_ms) AS hi FROM sb GROUP BY 1, 2)"
_GR = "gr AS (SELECT series_id, min(t_ms) AS a, max(t_ms) AS b, coalesce(min(st), 4611686018427387904) AS cap FROM (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY series_id ORDER BY t_ms) AS st FROM ug) GROUP BY 1)"
_chosen = lambda cap: f"{_COV}, {_GR}, sel AS (SELECT gr.series_id, a, b, max(freq_ms) AS freq_ms FROM gr JOIN cov USING (series_id) WHERE freq_ms <= {cap} AND lo <= a AND hi >= b GROUP BY 1, 2, 3), bars AS (SELECT sb.* FROM sb JOIN sel USING (series_id, freq_ms) WHERE t_ms BETWEEN a AND b)"
_ALIGNED = "SELECT ug.series_id, ug.t_ms, bars.value FROM ug JOIN sel USING (series_id) LEFT JOIN bars ON ug.series_id = bars.series_id AND ug.t_ms = bars.t_ms"
add("get_aligned", lambda spark, d: B.on_grid(V.buckets(spark, d), V.user_grid(spark, d), "exact"), _with(sql("sb ug", _ALIGNED), _chosen("cap")))
add("get_filled", lambda spark, d: B.on_grid(V.buckets(spark, d), V.user_grid(spark, d), "latest"), _with(sql("sb ug", "SELECT u.series_id, u.t_ms, coalesce(bars.value, f.value) AS value FROM (SELECT ug.* FROM ug JOIN sel USING (series_id)) u LEFT JOIN (SELECT series_id, arg_min(value, t_ms) AS value FROM bars GROUP BY 1) f USING (series_id) ASOF LEFT JOIN bars ON u.series_id = bars.series_id AND u.t_ms >= bars.t_ms"), _chosen("4611686018427387904")))


def _raw(spark, d, cap):
    asks = _requests(spark, d).select(K, (F.col("a") + DAY).alias("a"), "b", F.lit(cap).cast("long").alias("cap"))
    stored = V.buckets(spark, d)
    return B.read(stored, B.select_bucket(stored, asks, finest_first=True))


_RAW = lambda cap: f"{_COV}, rs AS (SELECT series_id, q.a + {DAY} AS a, b, min(freq_ms) AS freq_ms FROM ({_RQ}) q JOIN cov USING (series_id) WHERE freq_ms <= {cap} AND lo <= q.a + {DAY} AND hi >= b GROUP BY 1, 2, 3)"
_RAWS = "SELECT series_id, CAST(freq_ms AS BIGINT) AS freq_ms, t_ms, value FROM rs JOIN sb USING (series_id, freq_ms) WHERE t_ms BETWEEN a AND b"
add("set_frequency", lambda spark, d: _raw(spark, d, HOUR), _with(sql("sb", _RAWS), _RAW(HOUR)))


def _sources(spark, d):
    """A session's bars however it is opened: raw below a frequency, aligned to a grid, or given."""
    mode = lambda df, m: df.select(F.lit(m).alias("mode"), K, "t_ms", "value")
    aligned = B.on_grid(V.buckets(spark, d), V.user_grid(spark, d), "exact").where("value IS NOT NULL")
    return mode(_raw(spark, d, DAY), "raw").unionByName(mode(aligned, "aligned")).unionByName(mode(V.buckets(spark, d).where(F.col("freq_ms") == DAY), "given"))


add("session_source", _sources, _with(sql("sb ug", f"SELECT 'raw' AS mode, series_id, t_ms, value FROM ({_RAWS}) UNION ALL SELECT 'aligned', series_id, t_ms, value FROM ({_ALIGNED}) WHERE value IS NOT NULL UNION ALL SELECT 'given', series_id, t_ms, value FROM sb WHERE freq_ms = {DAY}"), f"{_chosen('cap')}, {_RAW(DAY).removeprefix(_COV + ', ')}"))

# Single points.
_T0 = 1_704_672_000_000
_ASKED = (_T0, _T0 + 90 * 60_000, _T0 - 400 * DAY)


def _asks(spark, d):
    return V.series(spark, d).select(K).distinct().withColumn("t_ms", F.explode(F.array(*[F.lit(t).cast("long") for t in _ASKED])))


_AQ = f"ask AS (SELECT DISTINCT series_id, unnest({list(_ASKED)}) AS t_ms FROM s), ex AS (SELECT series_id, t_ms, arg_min(value, freq_ms) AS value FROM ask JOIN sb USING (series_id, t_ms) GROUP BY 1, 2)"
_ASOF = "bf AS (SELECT q.series_id, q.t_ms, arg_min(sb.value, q.freq_ms) AS value FROM (SELECT * FROM ask JOIN (SELECT DISTINCT series_id, freq_ms FROM sb) USING (series_id)) q ASOF JOIN sb ON q.series_id = sb.series_id AND q.freq_ms = sb.freq_ms AND q.t_ms >= sb.t_ms GROUP BY 1, 2)"
add("point_asof", lambda spark, d: B.points(V.buckets(spark, d), _asks(spark, d)), _with(sql("sb", "SELECT ask.series_id, ask.t_ms, coalesce(ex.value, bf.value) AS value, CASE WHEN coalesce(ex.value, bf.value) IS NULL THEN concat('no data for ', ask.series_id, ' at ', ask.t_ms) END AS error FROM ask LEFT JOIN ex USING (series_id, t_ms) LEFT JOIN bf USING (series_id, t_ms)"), f"{_AQ}, {_ASOF}"))
add("point_exact_or_error", lambda spark, d: B.points(V.buckets(spark, d), _asks(spark, d), exact_only=True), _with(sql("sb", "SELECT ask.series_id, ask.t_ms, ex.value, CASE WHEN ex.value IS NULL THEN concat('no exact data for ', ask.series_id, ' at ', ask.t_ms) END AS error FROM ask LEFT JOIN ex USING (series_id, t_ms)"), _AQ))


# Return features: two series and three metrics of each base series, as one long table.
def return_features(base):
    """(series_id, item, t_ms, value): logReturn and simpleReturn by tick, and their metrics as of the last tick."""
    logs = S.returns(base, "log").where("value IS NOT NULL")
    rows = lambda df, item: df.select(K, F.lit(item).alias("item"), "t_ms", "value")
    of_logs = logs.groupBy(K).agg(F.max("t_ms").alias("t_ms"), stats.sharpe_annualized("value").alias("sharpe"), stats.volatility("value").alias("annualizedVolatility"))
    metrics = of_logs.unpivot([K, "t_ms"], ["sharpe", "annualizedVolatility"], "item", "value").unionByName(base.groupBy(K).agg(F.max("t_ms").alias("t_ms"), stats.total_return().alias("value")).select(K, F.lit("totalReturn").alias("item"), "t_ms", "value"))
    series = rows(logs, "logReturn").unionByName(rows(S.returns(base, "simple").where("value IS NOT NULL"), "simpleReturn"))
    return series.unionByName(metrics.where(S.finite(F.col("value"))))


_FEATURES = lambda base: f"""fr AS (SELECT series_id, t_ms, value, lag(value) OVER (PARTITION BY series_id ORDER BY t_ms) AS b FROM {base}),
fl AS (SELECT series_id, t_ms, ln(value / b) AS value FROM fr WHERE b > 0 AND value > 0),
fs AS (SELECT series_id, 'logReturn' AS item, t_ms, value FROM fl UNION ALL SELECT series_id, 'simpleReturn', t_ms, (value - b) / b FROM fr WHERE b > 0 AND value >= 0
UNION ALL SELECT series_id, 'sharpe', max(t_ms), avg(value) / stddev_samp(value) * sqrt(252) FROM fl GROUP BY 1 UNION ALL SELECT series_id, 'annualizedVolatility', max(t_ms), stddev_samp(value) * sqrt(252) FROM fl GROUP BY 1
UNION ALL SELECT series_id, 'totalReturn', max(t_ms), (arg_max(value, t_ms) - arg_min(value, t_ms)) / arg_min(value, t_ms) FROM {base} GROUP BY 1)"""  # noqa: E731
_FS = f"SELECT series_id, item, t_ms, {exact_sql('value', 5)} AS value FROM fs WHERE value IS NOT NULL AND isfinite(value)"
_shown = lambda df: df.withColumn("value", exact("value", 5))
add("default_return_features", lambda spark, d: _shown(return_features(V.prices(spark, d))), _with(sql("p", _FS), _FEATURES("p")))
# The same for each asset over a range at the finest frequency that a cap allows.
add("asset_analysis", lambda spark, d: _shown(return_features(_raw(spark, d, HOUR).select(K, "t_ms", "value"))), _with(sql("sb", _FS), f"{_RAW(HOUR)}, rawbars AS (SELECT series_id, t_ms, value FROM ({_RAWS})), {_FEATURES('rawbars')}"))
add("stat_minmax", lambda spark, d: V.series(spark, d).where(S.finite(F.col("value"))).groupBy(K).agg(F.min("value").alias("min"), F.max("value").alias("max")), sql("s", "SELECT series_id, min(value) AS min, max(value) AS max FROM s GROUP BY 1"))


# Portfolios from their snapshots.
def _loaded(spark, d):
    log = V.txns(spark, d)
    snapshot = L.snapshot_at(log, MID)
    return L.snapshot_at(L.seeds(snapshot, MID).unionByName(log.where(F.col("t_ms") > MID)))


add("portfolio_load", lambda spark, d: r6(_loaded(spark, d), "quantity", n=2), PQ.ORACLES["portfolio_build"])
add("portfolio_metadata", lambda spark, d: PQ._snapshots(spark, d).groupBy(PID).agg(F.max("t_ms").alias("t_ms")).join(V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("name")), F.col(PID) == F.col("n")).select(PID, "name", F.lit("USD").alias("base_currency"), "t_ms"), sql("hold", "SELECT portfolio_id, n_name AS name, 'USD' AS base_currency, max(t_ms) AS t_ms FROM hold JOIN nation ON n_nationkey = portfolio_id GROUP BY 1, 2"))

_GRIDS = """held AS (SELECT portfolio_id, asset FROM hold GROUP BY 1, 2 HAVING bool_or(quantity <> 0)),
want AS (SELECT portfolio_id, currency FROM held JOIN den USING (asset) WHERE currency <> 'USD' UNION SELECT portfolio_id, substr(asset, 6) FROM held WHERE asset LIKE 'CASH:%' AND substr(asset, 6) <> 'USD')"""
add("portfolio_grid", PQ._grid_all, _with(sql("hold den p fx", "SELECT DISTINCT portfolio_id, t_ms FROM (SELECT portfolio_id, p.t_ms FROM held JOIN p ON p.series_id = held.asset UNION ALL SELECT portfolio_id, fx.t_ms FROM want JOIN fx ON fx.series_id = want.currency)"), _GRIDS))

_GRID_ROWS = "SELECT DISTINCT portfolio_id, fx.series_id, fx.t_ms FROM want JOIN fx ON fx.series_id = want.currency"
add("portfolio_grid_intersection", PQ._grid_common, _with(sql("hold den fx", "SELECT portfolio_id, t_ms FROM gr JOIN (SELECT portfolio_id, count(DISTINCT series_id) AS n FROM gr GROUP BY 1) USING (portfolio_id) GROUP BY portfolio_id, t_ms, n HAVING count(*) = n"), f"{_GRIDS}, gr AS ({_GRID_ROWS})"))

# Transaction logs: all transactions, with ids that no two portfolios share.
_log = lambda spark, d: V.txns(spark, d).withColumn("id", F.concat_ws(":", F.col(PID).cast("string"), "id"))
_LOG = "lg AS (SELECT * REPLACE (concat_ws(':', portfolio_id, id) AS id) FROM txn)"
_of_log = lambda body: _with(sql("txn", body), _LOG)
_half = PQ._half
add("txn_append_dedupe", lambda spark, d: L.append_dedupe(_half(_log(spark, d), 0), _log(spark, d).where(F.col("t_ms") < MID)).select(PID, "id"), _of_log(f"SELECT portfolio_id, id FROM lg WHERE length(id) % 2 = 0 OR t_ms < {MID}"))

# Calendars from the first to the last order and beyond, and recurrences of every order.
_LOCAL = 9 * HOUR
add("calendar_schedule", lambda spark, d: C.trading_days(spark, PQ._A, PQ._B, V.holidays(spark, d)).select((F.unix_millis(F.col("day").cast("timestamp")) - _LOCAL).alias("t_ms")), sql("td", f"SELECT epoch_ms(CAST(day AS TIMESTAMP)) - {_LOCAL} AS t_ms FROM td"))
_OD = "od AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), oe AS (SELECT min(day) AS f, max(day) AS l FROM od)"
_RT = lambda months: f"""{_OD}, cx AS (SELECT CAST(unnest(generate_series(CAST(f - 31 AS TIMESTAMP), CAST(l + INTERVAL {months} MONTH AS TIMESTAMP) + INTERVAL 31 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM oe),
tx AS (SELECT cx.day AS t FROM cx, oe WHERE isodow(cx.day) < 6 AND NOT (month(cx.day) = 1 AND day(cx.day) = 1) AND NOT (cx.day BETWEEN f AND l AND cx.day NOT IN (SELECT day FROM od))),
rx AS (SELECT cx.day, min(t) FILTER (t >= cx.day) AS following, max(t) FILTER (t <= cx.day) AS preceding FROM cx, tx GROUP BY 1),
ra AS (SELECT rx.* FROM rx, oe WHERE rx.day BETWEEN f AND CAST(l + INTERVAL {months} MONTH AS DATE))"""  # noqa: E731
for _n, _e in _FORMS.items():
    add_days(f"roll_{_n}", lambda spark, d, n=_n: _calendar(spark, d).select("day", C.roll(n).alias("rolled")), f"WITH {_RT(0)} SELECT day, {_e} AS rolled FROM ra", "day", "rolled")

add_days("recurrence_raw", lambda spark, d: C.recurrence(_rules(spark, d)).select("o_orderkey", "day"), f"WITH {_REC} SELECT o_orderkey, day FROM rc WHERE day <= en", "day")


def _rolled(spark, d):
    """(o_orderkey, rolled), each once.

    Orders that share a rule share its days: a rule is expanded and rolled once. Rows of different orders differ, so only orders whose
    key comes several times are compared by their days.
    """
    rule, rules = ["start", "end", "unit", "step"], _rules(spark, d)
    rolled = _calendar(spark, d, 18).select("day", C.roll("modified_following").cast("string").alias("rolled"))
    days = C.recurrence(rules.select(*rule).distinct()).join(F.broadcast(rolled), "day").groupBy(*rule).agg(F.collect_set("rolled").alias("days"))
    counted = rules.withColumn("_n", F.count("*").over(W.partitionBy("o_orderkey")))
    each = lambda some: counted.where(some).join(days.hint("shuffle_hash"), rule).select("o_orderkey", F.explode("days").alias("rolled"))
    return each("_n = 1").unionByName(each("_n > 1").distinct())


_ROLL = f"WITH {_RT(18)}, {_REC} SELECT DISTINCT o_orderkey, {_FORMS['modified_following']} AS rolled{{more}} FROM rc JOIN ra USING (day) WHERE rc.day <= en"
add_days("recurrence_rolled", lambda spark, d: _rolled(spark, d), _ROLL.format(more=""), "rolled")
add_days("events_recurring", lambda spark, d: _rolled(spark, d).select("o_orderkey", "rolled", F.lit("Coupon").alias("kind"), F.lit(1.5).alias("amount_per_unit"), F.lit(True).alias("projected")), _ROLL.format(more=", 'Coupon' AS kind, 1.5::DOUBLE AS amount_per_unit, true AS projected"), "rolled")
