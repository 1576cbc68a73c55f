"""Registered queries: series algebra, grids, resampling, statistics, windows, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import intervals as I
from ..operators import resample as R
from ..operators import series as S
from . import views as V
from .views import DAY, HOUR, sql

QUERIES: dict = {}
ORACLES: dict = {}
K = "series_id"


def add(name: str, run, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered already")
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def r6(df, *cols, n=6):
    """Round the named columns, without negative zeros."""
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if c in cols else c for c in df.columns])


def exact(c, n: int = 2, name: str | None = None):
    """The value rounded half up at n places as a decimal, so that no engine's binary rounding moves an exact half."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast(f"decimal(38,{n + 2})"), n).cast("double") + 0.0
    return out.alias(name) if name else out


def away(c, n: int):
    """Rounded as SQL's ``round`` on doubles does it: the product with 10^n to the nearest whole number, halves away from zero."""
    return F.round(c * float(10**n)) / float(10**n)


def exact_sql(x: str, n: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,{n + 2})), {n}) AS DOUBLE) + 0.0"


# Algebra: a user's series with itself shifted by one tick, so that both sides differ.
def _pair(spark, d):
    s = V.series(spark, d)
    return s, S.shift(s, 1)


for _op, _expr in {"add": "value + b", "sub": "value - b", "mul": "value * b", "div": "CASE WHEN b = 0 THEN 0 ELSE value / b END"}.items():
    add(f"series_{_op}", lambda spark, d, op=_op: r6(S.combine(*_pair(spark, d), op), "value"), sql("s", f"SELECT series_id, t_ms, round({_expr}, 6) + 0.0 AS value FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t_ms) AS b FROM s) WHERE b IS NOT NULL"))
add("series_align_check", lambda spark, d: S.misaligned(*_pair(spark, d)), sql("s", "SELECT series_id, CAST(1 AS BIGINT) AS n_misaligned FROM s GROUP BY 1"))
add("series_scalar", lambda spark, d: r6(S.scalar(S.scalar(V.series(spark, d), "mul", 3), "sub", 1.5), "value"), sql("s", "SELECT series_id, t_ms, round(value * 3 - 1.5, 6) + 0.0 AS value FROM s"))
add("view_arith", lambda spark, d: r6(V.series(spark, d).withColumn("value", F.col("value") - F.lag("value", 2).over(S.over())).where("value IS NOT NULL"), "value"), sql("s", "SELECT series_id, t_ms, round(value - b, 6) + 0.0 AS value FROM (SELECT *, lag(value, 2) OVER (PARTITION BY series_id ORDER BY t_ms) AS b FROM s) WHERE b IS NOT NULL"))
add("series_apply", lambda spark, d: r6(V.series(spark, d).withColumn("value", F.sqrt("value")), "value"), sql("s", "SELECT series_id, t_ms, round(sqrt(value), 6) AS value FROM s"))
add("series_slice", lambda spark, d: S.positions(V.series(spark, d)).where(F.col("pos").between(3, 9)).select(K, "t_ms", "value"), sql("s", "SELECT series_id, t_ms, value FROM s QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t_ms) BETWEEN 4 AND 10"))
_T0 = 1_704_672_000_000
add("series_slice_time", lambda spark, d: V.series(spark, d).where(F.col("t_ms").between(_T0, _T0 + 3 * DAY)), sql("s", f"SELECT * FROM s WHERE t_ms BETWEEN {_T0} AND {_T0 + 3 * DAY}"))
add("scan_series_range", lambda spark, d: V.series(spark, d).where(F.col("t_ms").between(_T0, _T0 + DAY)), sql("s", f"SELECT * FROM s WHERE t_ms BETWEEN {_T0} AND {_T0 + DAY}"))
add("series_shift", lambda spark, d: S.shift(V.series(spark, d), 2), sql("s", "SELECT series_id, t_ms, b AS value FROM (SELECT *, lag(value, 2) OVER (PARTITION BY series_id ORDER BY t_ms) AS b FROM s) WHERE b IS NOT NULL"))
add("series_bounds", lambda spark, d: S.bounds(V.series(spark, d), _T0), sql("s", f"SELECT series_id, count(*) FILTER (t_ms < {_T0}) AS lower, count(*) FILTER (t_ms <= {_T0}) AS upper FROM s GROUP BY 1"))
add("point_exact", lambda spark, d: R.resample(V.series(spark, d), V.series(spark, d).select(K, (F.floor(F.col("t_ms") / 2) * 2).alias("t_ms")).distinct(), "exact"), sql("s", "SELECT q.series_id, q.t_ms, s.value FROM (SELECT DISTINCT series_id, t_ms // 2 * 2 AS t_ms FROM s) q LEFT JOIN s ON s.series_id = q.series_id AND s.t_ms = q.t_ms"))
add("log_returns", lambda spark, d: r6(S.returns(V.prices(spark, d), "log"), "value"), sql("lr", "SELECT series_id, t_ms, round(value, 6) + 0.0 AS value FROM lr"))
add("simple_returns", lambda spark, d: r6(S.returns(V.prices(spark, d), "simple"), "value"), sql("p", "SELECT series_id, t_ms, round(CASE WHEN b > 0 AND value >= 0 THEN (value - b) / b END, 6) + 0.0 AS value FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t_ms) AS b, row_number() OVER (PARTITION BY series_id ORDER BY t_ms) AS r FROM p) WHERE r > 1"))
_Z = "SELECT series_id, t_ms, value, CASE WHEN stddev_pop(value) OVER (PARTITION BY series_id) < 1e-9 THEN 0 ELSE (value - avg(value) OVER (PARTITION BY series_id)) / stddev_pop(value) OVER (PARTITION BY series_id) END AS z FROM s"
add("zscore", lambda spark, d: r6(S.zscores(V.series(spark, d)), "z"), sql("s", f"SELECT series_id, t_ms, value, round(z, 6) + 0.0 AS z FROM ({_Z})"))
add("outliers", lambda spark, d: r6(S.zscores(V.series(spark, d)).where("abs(z) > 3"), "z"), sql("s", f"SELECT series_id, t_ms, value, round(z, 6) + 0.0 AS z FROM ({_Z}) WHERE abs(z) > 3"))
add("iso_format", lambda spark, d: V.series(spark, d).select(K, "t_ms", F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso")), sql("s", "SELECT series_id, t_ms, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM s"))
add("iso_parse", lambda spark, d: V.series(spark, d).select(K, F.unix_millis(F.to_timestamp(F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))).alias("t_ms")), sql("s", "SELECT series_id, t_ms FROM s"))
add("date_format", lambda spark, d: V.series(spark, d).select(K, F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd").alias("day")), sql("s", "SELECT series_id, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%d') AS day FROM s"))
add("duration_label", lambda spark, d: V.series(spark, d).groupBy(K).agg(S.duration_label((F.floor((F.max("t_ms") - F.min("t_ms")) / HOUR) * HOUR).cast("long")).alias("label")), sql("s", f"SELECT series_id, CASE WHEN h >= 24 THEN (h // 24) || 'd' ELSE '' END || CASE WHEN h % 24 > 0 THEN (h % 24) || 'h' ELSE '' END || CASE WHEN h = 0 THEN '0ms' ELSE '' END AS label FROM (SELECT series_id, (max(t_ms) - min(t_ms)) // {HOUR} AS h FROM s GROUP BY 1)"))
add("series_head", lambda spark, d: S.ends(V.series(spark, d), 3), sql("s", "SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t_ms) <= 3"))
add("series_tail", lambda spark, d: S.ends(V.series(spark, d), 3, last=True), sql("s", "SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t_ms DESC) <= 3"))

# Stored buckets.
add("available_frequencies", lambda spark, d: V.buckets(spark, d).select(K, "freq_ms").distinct(), sql("sb", "SELECT DISTINCT series_id, CAST(freq_ms AS BIGINT) AS freq_ms FROM sb"))
add("coverage", lambda spark, d: V.buckets(spark, d).groupBy(K, "freq_ms").agg(F.min("t_ms").alias("from_ms"), F.max("t_ms").alias("to_ms")), sql("sb", "SELECT series_id, CAST(freq_ms AS BIGINT) AS freq_ms, min(t_ms) AS from_ms, max(t_ms) AS to_ms FROM sb GROUP BY 1, 2"))
add("series_capabilities", lambda spark, d: V.buckets(spark, d).groupBy(K).agg(F.min("t_ms").alias("earliest_ms"), F.min("freq_ms").alias("finest_ms")), sql("sb", "SELECT series_id, min(t_ms) AS earliest_ms, CAST(min(freq_ms) AS BIGINT) AS finest_ms FROM sb GROUP BY 1"))
add("scan_finest", lambda spark, d: V.buckets(spark, d).withColumn("f", F.min("freq_ms").over(W.partitionBy(K))).where("freq_ms = f").drop("f"), sql("sb", "SELECT series_id, CAST(freq_ms AS BIGINT) AS freq_ms, t_ms, value FROM sb WHERE freq_ms = 60000"))
add("series_exists", lambda spark, d: V.table(spark, d, "customer").select(F.col("c_custkey").alias(K)).join(V.buckets(spark, d), K, "left_semi"), sql("sb", "SELECT c_custkey AS series_id FROM customer WHERE c_custkey IN (SELECT series_id FROM sb)"))


def _requests(spark, d):
    return V.series(spark, d).groupBy(K).agg((F.min("t_ms") - DAY).alias("a"), (F.floor(F.avg("t_ms") / DAY) * DAY).cast("long").alias("b"))


def _gaps(spark, d):
    """Head and tail of each request outside the stored extent."""
    c = V.series(spark, d).groupBy(K).agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))
    head = F.when(F.col("a") < F.col("lo"), F.struct(F.col("a").alias("gap_from"), F.least("b", F.col("lo") - 1).alias("gap_to")))
    tail = F.when(F.col("b") > F.col("hi"), F.struct(F.greatest("a", F.col("hi") + 1).alias("gap_from"), F.col("b").alias("gap_to")))
    return _requests(spark, d).join(c, K).select(K, F.explode(F.filter(F.array(head, tail), lambda x: x.isNotNull())).alias("g")).select(K, "g.*")


_RQ = f"SELECT series_id, min(t_ms) - {DAY} AS a, CAST(floor(avg(t_ms) / {DAY}) AS BIGINT) * {DAY} AS b FROM s GROUP BY 1"
add("coverage_gaps", _gaps, sql("s", f"SELECT series_id, a AS gap_from, least(b, lo - 1) AS gap_to FROM ({_RQ}) JOIN (SELECT series_id, min(t_ms) AS lo, max(t_ms) AS hi FROM s GROUP BY 1) USING (series_id) WHERE a < lo"))


def _select(spark, d):
    """The finest bucket that covers each request from its second day to its end."""
    cov = V.buckets(spark, d).groupBy(K, "freq_ms").agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))
    q = _requests(spark, d).select(K, (F.col("a") + DAY).alias("a"), "b")
    return q.join(cov, K).where("lo <= a AND hi >= b").groupBy(K, "a", "b").agg(F.min("freq_ms").alias("freq_ms"))


_SEL = f"SELECT series_id, q.a + {DAY} AS a, b, min(freq_ms) AS freq_ms FROM ({_RQ}) q JOIN (SELECT series_id, freq_ms, min(t_ms) AS lo, max(t_ms) AS hi FROM sb GROUP BY 1, 2) USING (series_id) WHERE lo <= q.a + {DAY} AND hi >= b GROUP BY 1, 2, 3"
add("bucket_select", _select, sql("sb", f"SELECT series_id, a, b, CAST(freq_ms AS BIGINT) AS freq_ms FROM ({_SEL})"))
add("get_raw", lambda spark, d: _select(spark, d).join(V.buckets(spark, d), [K, "freq_ms"]).where("t_ms BETWEEN a AND b").select(K, "freq_ms", "t_ms", "value"), sql("sb", f"SELECT series_id, CAST(sb.freq_ms AS BIGINT) AS freq_ms, t_ms, value FROM ({_SEL}) x JOIN sb USING (series_id, freq_ms) WHERE t_ms BETWEEN a AND b"))


def _merge(spark, d):
    s = S.positions(V.series(spark, d))
    old, new = s.where("pos % 3 <> 0").select(K, "t_ms", "value"), s.where("pos % 2 = 0").select(K, "t_ms", (F.col("value") * 10).alias("value"))
    return r6(S.merge(old, new), "value")


add("series_merge", _merge, sql("s", "SELECT series_id, t_ms, round(CASE WHEN pos % 2 = 0 THEN value * 10 ELSE value END, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_ms) - 1 AS pos FROM s) WHERE pos % 3 <> 0 OR pos % 2 = 0"))


def _backfill(spark, d):
    """Requested gaps taken from the daily bucket and merged into the fine series."""
    up = V.buckets(spark, d).where(F.col("freq_ms") == DAY)
    pulled = _gaps(spark, d).join(up, K).where("t_ms BETWEEN gap_from AND gap_to").select(K, "t_ms", "value")
    return S.merge(V.series(spark, d), pulled)


add("gap_backfill", _backfill, sql("sb", f"SELECT * FROM s UNION ALL SELECT sb.series_id, t_ms, value FROM sb JOIN (SELECT series_id, a, b, lo FROM ({_RQ}) JOIN (SELECT series_id, min(t_ms) AS lo FROM s GROUP BY 1) USING (series_id)) q ON q.series_id = sb.series_id WHERE freq_ms = {DAY} AND t_ms BETWEEN a AND least(b, lo - 1)"))
add("strip_nan", lambda spark, d: V.series(spark, d).withColumn("value", F.when(F.col("t_ms") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).where(S.finite(F.col("value"))), sql("s", "SELECT * FROM s WHERE t_ms % 7 <> 0"))

# Grids and resampling on whole hours of each user's range.
add("grid_regular", lambda spark, d: V.user_grid(spark, d), sql("ug", "SELECT * FROM ug"))
add("series_constant", lambda spark, d: V.user_grid(spark, d).withColumn("value", F.lit(1.0)), sql("ug", "SELECT *, 1.0::DOUBLE AS value FROM ug"))
for _how in ("latest", "linear", "nearest", "exact"):
    _l = "l AS (SELECT ug.series_id, ug.t_ms, s.t_ms AS lt, s.value AS lv FROM ug ASOF LEFT JOIN s ON ug.series_id = s.series_id AND ug.t_ms >= s.t_ms), b AS (SELECT l.*, s.t_ms AS rt, s.value AS rv FROM l ASOF LEFT JOIN s ON l.series_id = s.series_id AND l.t_ms < s.t_ms)"
    _in = {"latest": "lv", "linear": "lv + (t_ms - lt) / CAST(rt - lt AS DOUBLE) * (rv - lv)", "nearest": "CASE WHEN t_ms - lt < rt - t_ms THEN lv ELSE rv END", "exact": ""}[_how]
    _sql = "SELECT ug.series_id, ug.t_ms, round(s.value, 6) AS value FROM ug LEFT JOIN s ON ug.series_id = s.series_id AND ug.t_ms = s.t_ms" if _how == "exact" else f"SELECT series_id, t_ms, round(CASE WHEN lt IS NULL THEN rv WHEN lt = t_ms OR rt IS NULL THEN lv ELSE {_in} END, 6) + 0.0 AS value FROM b"
    add(f"resample_{_how}", lambda spark, d, how=_how: r6(R.resample(V.series(spark, d), V.user_grid(spark, d), how), "value"), sql("s ug", _sql) if _how == "exact" else sql("s ug", _sql).replace("\nSELECT", f",\n{_l}\nSELECT", 1))
add("resample_stochastic", lambda spark, d: R.stochastic(V.series(spark, d), V.user_grid(spark, d), 1e-9))
add("series_step", lambda spark, d: R.step_series(V.series(spark, d).withColumn("seq", F.col("value")), V.user_grid(spark, d), -1.0), sql("s ug", "SELECT ug.series_id, ug.t_ms, coalesce(s.value, -1) AS value FROM ug ASOF LEFT JOIN s ON ug.series_id = s.series_id AND ug.t_ms >= s.t_ms"))


def _order_spans(spark, d):
    """Half-open spans of each customer's orders, of none to 39 days; one in 50 is open."""
    o = V.table(spark, d, "orders").select("o_custkey", V.ms("o_orderdate").alias("begin"), "o_orderkey")
    return o.select("o_custkey", "begin", F.when(F.col("o_orderkey") % 50 != 7, F.col("begin") + (F.col("o_orderkey") % 40) * DAY).alias("end"))


def _masked(spark, d):
    begin, end, step = (F.lit(x).cast("long") for x in V.GRID)
    ticks = V.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.sequence(begin, end, step)).alias("t_ms"))
    return I.segment_mask(ticks, _order_spans(spark, d), ["o_custkey"], 60 * DAY)


add("segment_mask", _masked, sql("g", f"SELECT o_custkey, t_ms, CASE WHEN n > 0 THEN 1 ELSE 0 END AS mask, n AS n_segments FROM (SELECT c.c_custkey AS o_custkey, g.t_ms, count(b) AS n FROM customer c CROSS JOIN g LEFT JOIN (SELECT o_custkey, epoch_us(o_orderdate) // 1000 AS b, CASE WHEN o_orderkey % 50 <> 7 THEN epoch_us(o_orderdate) // 1000 + (o_orderkey % 40) * {DAY} END AS e FROM orders) s ON s.o_custkey = c.c_custkey AND g.t_ms >= b AND (e IS NULL OR g.t_ms < e) GROUP BY 1, 2)"))
add("variance_rate", lambda spark, d: R.variance_rate(V.series(spark, d)).withColumn("variance_rate", F.round(F.col("variance_rate") * 1e6, 6)), sql("s", "SELECT series_id, round(CASE WHEN max(t_ms) = min(t_ms) THEN 0 ELSE coalesce(sum(q * q), 0) / (max(t_ms) - min(t_ms)) END * 1e6, 6) AS variance_rate FROM (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY t_ms) AS q FROM s) GROUP BY 1"))
add("grid_union", lambda spark, d: R.grid_union(V.by_type(spark, d)), sql("st", "SELECT DISTINCT t_ms FROM st"))
add("grid_intersection", lambda spark, d: R.grid_intersection(V.by_type(spark, d), K, 5), sql("st", "SELECT t_ms FROM st GROUP BY 1 HAVING count(DISTINCT series_id) = 5"))
add("regularity_check", lambda spark, d: r6(R.regularity(V.by_type(spark, d)), "sd_step", n=3), sql("st", "SELECT series_id, count(*) AS n, list_sort(list(q) FILTER (q IS NOT NULL))[count(q) // 2 + 1]::DOUBLE AS median_step, round(stddev_pop(q), 3) AS sd_step, count(*) < 3 OR stddev_pop(q) <= greatest(0.05 * list_sort(list(q) FILTER (q IS NOT NULL))[count(q) // 2 + 1], 1) AS regular FROM (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY series_id ORDER BY t_ms) AS q FROM st) GROUP BY 1"))
add("regularity_gate", lambda spark, d: V.by_type(spark, d).join(R.regularity(V.by_type(spark, d), 1.0).where("regular").select(K), K, "left_semi").groupBy(K).agg(F.count("*").alias("n")), sql("st", "SELECT series_id, count(*) AS n FROM (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY series_id ORDER BY t_ms) AS q FROM st) GROUP BY 1 HAVING count(*) < 3 OR stddev_pop(q) <= greatest(1.0 * list_sort(list(q) FILTER (q IS NOT NULL))[count(q) // 2 + 1], 1)"))

# Statistics of the series of users.
_SK = "(avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * avg(value) ** 3) / stddev_pop(value) ** 3"
_STATS = {
    "stat_mean": (lambda: stats.mean("value"), "avg(value)"), "stat_variance": (lambda: stats.variance("value"), "var_samp(value)"), "stat_std": (lambda: stats.std("value", False), "stddev_pop(value)"),
    "stat_skew": (lambda: stats.skew("value"), _SK), "stat_kurtosis": (lambda: stats.kurtosis("value"), "kurtosis_pop(value) + 3"), "stat_excess_kurtosis": (lambda: stats.excess_kurtosis("value"), "kurtosis_pop(value)"),
    "stat_quantile": (lambda: stats.quantile("value", 0.9), "quantile_cont(value, 0.9)"), "stat_cdf": (lambda: stats.cdf("value", 10), "avg(CAST(value <= 10 AS INT))"),
    "jarque_bera": (lambda: stats.jarque_bera("value"), f"count(*) / 6.0 * (({_SK}) ** 2 + kurtosis_pop(value) ** 2 / 4)"), "total_return": (lambda: stats.total_return(), "(arg_max(value, t_ms) - arg_min(value, t_ms)) / arg_min(value, t_ms)"),
}
for _n, (_f, _e) in _STATS.items():
    add(_n, lambda spark, d, n=_n, f=_f: V.series(spark, d).groupBy(K).agg((away(f(), 4) + 0.0).alias(n)), sql("s", f"SELECT series_id, round({_e}, 4) + 0.0 AS {_n} FROM s GROUP BY 1"))
for _n, _f, _e in (("volatility", lambda: stats.volatility("value"), "stddev_samp(value) * sqrt(252)"), ("sharpe", lambda: stats.sharpe("value"), "avg(value) / stddev_samp(value)"), ("sharpe_annualized", lambda: stats.sharpe_annualized("value"), "avg(value) / stddev_samp(value) * sqrt(252)")):
    add(_n, lambda spark, d, n=_n, f=_f: S.returns(V.prices(spark, d)).groupBy(K).agg((F.round(f(), 6) + 0.0).alias(n)), sql("lr", f"SELECT series_id, round({_e}, 6) + 0.0 AS {_n} FROM lr GROUP BY 1"))


def _describe(df, c="value"):
    q = lambda x: F.round(stats.quantile(c, x), 4)
    return df.groupBy(K).agg(F.count(c).alias("n"), F.count(F.when(~S.finite(F.col(c)), 1)).alias("n_bad"), F.round(stats.mean(c), 4).alias("mean"), F.round(stats.std(c), 4).alias("sd"), F.min(c).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(c).alias("max"))


_DESC = "count(value) AS n, CAST(0 AS BIGINT) AS n_bad, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q1, round(median(value), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, max(value) AS max"
add("series_describe", lambda spark, d: _describe(V.series(spark, d)), sql("s", f"SELECT series_id, {_DESC} FROM s GROUP BY 1"))
add("distribution_from", lambda spark, d: _describe(V.series(spark, d)).withColumn("iqr", F.round(F.col("q3") - F.col("q1"), 3)).select(K, "n", "mean", "sd", "iqr"), sql("s", "SELECT series_id, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(round(quantile_cont(value, 0.75), 4) - round(quantile_cont(value, 0.25), 4), 3) AS iqr FROM s GROUP BY 1"))
_LAGS = "x AS (SELECT series_id, value - avg(value) OVER (PARTITION BY series_id) AS x, row_number() OVER (PARTITION BY series_id ORDER BY t_ms) AS r FROM st), ga AS (SELECT a.series_id, CAST(b.r - a.r AS INT) AS lag, sum(a.x * b.x) AS gamma FROM x a JOIN x b ON a.series_id = b.series_id AND b.r - a.r BETWEEN 0 AND 5 GROUP BY 1, 2), ac AS (SELECT ga.series_id, ga.lag, ga.gamma / g0.gamma AS acf FROM ga JOIN ga g0 ON ga.series_id = g0.series_id AND g0.lag = 0)"
_lag = lambda body: sql("st", body).replace("\nSELECT", f",\n{_LAGS}\nSELECT", 1)
add("autocovariance", lambda spark, d: r6(stats.autocovariance(V.by_type(spark, d), 5), "gamma", n=4), _lag("SELECT series_id, lag, round(gamma, 4) + 0.0 AS gamma FROM ga"))
add("acf", lambda spark, d: r6(stats.acf(V.by_type(spark, d), 5), "acf"), _lag("SELECT series_id, lag, round(acf, 6) + 0.0 AS acf FROM ac"))
add("autocorrelation_at", lambda spark, d: r6(stats.acf(V.by_type(spark, d), 3).where("lag = 3").select(K, "acf"), "acf"), _lag("SELECT series_id, round(acf, 6) + 0.0 AS acf FROM ac WHERE lag = 3"))
add("toeplitz", lambda spark, d: r6(stats.toeplitz(V.by_type(spark, d), 4), "value", n=4), _lag("SELECT series_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(gamma, 4) + 0.0 AS value FROM range(4) a(i), range(4) b(j), ga WHERE lag = abs(i - j)"))
add("pacf", lambda spark, d: stats.levinson(V.by_type(spark, d), 2).select(K, (F.round(F.col("reflections")[0], 6) + 0.0).alias("pacf1"), (F.round(F.col("reflections")[1], 6) + 0.0).alias("pacf2")), _lag("SELECT a.series_id, round(a.acf, 6) + 0.0 AS pacf1, round((b.acf - a.acf ** 2) / (1 - a.acf ** 2), 6) + 0.0 AS pacf2 FROM ac a JOIN ac b ON a.series_id = b.series_id AND a.lag = 1 AND b.lag = 2"))
add("ar_fit_levinson", lambda spark, d: stats.levinson(V.by_type(spark, d), 2).select(K, (F.round(F.col("phi")[0], 6) + 0.0).alias("phi1"), (F.round(F.col("phi")[1], 6) + 0.0).alias("phi2")), _lag("SELECT a.series_id, round(a.acf * (1 - b.acf) / (1 - a.acf ** 2), 6) + 0.0 AS phi1, round((b.acf - a.acf ** 2) / (1 - a.acf ** 2), 6) + 0.0 AS phi2 FROM ac a JOIN ac b ON a.series_id = b.series_id AND a.lag = 1 AND b.lag = 2"))
add("correlation_matrix", lambda spark, d: r6(stats.correlation_matrix(V.by_type(spark, d)), "corr"), sql("st", "SELECT x.series_id AS a, y.series_id AS b, round(corr(x.value, y.value), 6) + 0.0 AS corr FROM st x JOIN st y ON x.t_ms = y.t_ms AND x.series_id < y.series_id GROUP BY 1, 2 UNION ALL SELECT DISTINCT series_id, series_id, 1.0::DOUBLE FROM st"))
_MET = ["total_return", "volatility", "sharpe"]


def _scalar_metrics(spark, d):
    r = S.returns(V.prices(spark, d)).groupBy(K).agg(stats.volatility("value").alias("volatility"), stats.sharpe("value").alias("sharpe"))
    wide = V.prices(spark, d).groupBy(K).agg(stats.total_return().alias("total_return")).join(r, K)
    return wide.unpivot([K], _MET, "metric", "x").where(S.finite(F.col("x"))).select(K, "metric", (F.round("x", 6) + 0.0).alias("x"))


_SM = "m AS (SELECT * FROM (SELECT series_id, (arg_max(value, t_ms) - arg_min(value, t_ms)) / arg_min(value, t_ms) AS total_return FROM p GROUP BY 1) JOIN (SELECT series_id, stddev_samp(value) * sqrt(252) AS volatility, avg(value) / stddev_samp(value) AS sharpe FROM lr GROUP BY 1) USING (series_id))"
for _n in ("scalar_metrics",):
    add(_n, _scalar_metrics, sql("lr", "SELECT series_id, metric, round(x, 6) + 0.0 AS x FROM (UNPIVOT m ON total_return, volatility, sharpe INTO NAME metric VALUE x)").replace("\nSELECT", f",\n{_SM}\nSELECT", 1))

# Windows.
_w = lambda a, b: S.over().rowsBetween(a, b)
_run = W.unboundedPreceding
add("moving_average", lambda spark, d: V.series(spark, d).select(K, "t_ms", F.when(F.count("value").over(_w(-4, 0)) == 5, F.round(F.avg("value").over(_w(-4, 0)), 6)).alias("ma")), sql("s", "SELECT series_id, t_ms, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS ma FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t_ms ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"))
add("running_welford", lambda spark, d: V.series(spark, d).select(K, "t_ms", F.count("value").over(_w(_run, 0)).alias("n"), exact(F.avg("value").over(_w(_run, 0)), 3, "mean"), exact(F.var_pop("value").over(_w(_run, 0)), 3, "var_pop")), sql("s", f"SELECT series_id, t_ms, count(value) OVER w AS n, {exact_sql('avg(value) OVER w', 3)} AS mean, {exact_sql('var_pop(value) OVER w', 3)} AS var_pop FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING)"))
add("running_extrema", lambda spark, d: V.series(spark, d).select(K, "t_ms", F.min("value").over(_w(_run, 0)).alias("lo"), F.max("value").over(_w(_run, 0)).alias("hi")), sql("s", "SELECT series_id, t_ms, min(value) OVER w AS lo, max(value) OVER w AS hi FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING)"))
add("drawdown", lambda spark, d: V.series(spark, d).withColumn("peak", F.max("value").over(_w(_run, 0))).groupBy(K).agg(F.round(F.max(F.col("peak") - F.col("value")), 6).alias("max_absolute"), F.round(F.max(F.when(F.col("peak") > 0, (F.col("peak") - F.col("value")) / F.col("peak"))), 6).alias("max_relative")), sql("s", "SELECT series_id, round(max(peak - value), 6) AS max_absolute, round(max(CASE WHEN peak > 0 THEN (peak - value) / peak END), 6) AS max_relative FROM (SELECT *, max(value) OVER (PARTITION BY series_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS peak FROM s) GROUP BY 1"))
add("threshold_crossing", lambda spark, d: S.positions(V.series(spark, d)).groupBy(K).agg(F.min(F.when(F.col("value") >= 30, F.col("pos"))).cast("long").alias("first_step")).withColumn("crossed", F.col("first_step").isNotNull()), sql("s", "SELECT series_id, min(pos) FILTER (value >= 30) AS first_step, min(pos) FILTER (value >= 30) IS NOT NULL AS crossed FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_ms) - 1 AS pos FROM s) GROUP BY 1"))
add("path_record", lambda spark, d: V.series(spark, d).groupBy(K).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_ms", "value"))), lambda x: F.round(x["value"] * 100).cast("long").cast("string")), ",").alias("path")), sql("s", "SELECT series_id, string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY t_ms) AS path FROM s GROUP BY 1"))
add("context_window", lambda spark, d: V.series(spark, d).select(K, "t_ms", F.array_join(F.transform(F.collect_list("value").over(_w(-2, 0)), lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("context")), sql("s", "SELECT series_id, t_ms, list_aggregate(list(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) OVER (PARTITION BY series_id ORDER BY t_ms ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 'string_agg', ',') AS context FROM s"))
for _n, _f, _e in (("rolling_mse", lambda e: e * e, "e * e"), ("rolling_mae", F.abs, "abs(e)")):
    add(_n, lambda spark, d, n=_n, f=_f: V.series(spark, d).withColumn("e", F.col("value") - F.lag("value").over(S.over())).where("e IS NOT NULL").select(K, "t_ms", exact(F.avg(f(F.col("e"))).over(_w(-9, 0)), 2, n)), sql("s", f"SELECT series_id, t_ms, {exact_sql(f'avg({_e}) OVER (PARTITION BY series_id ORDER BY t_ms ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)', 2)} AS {_n} FROM (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY t_ms) AS e FROM s) WHERE e IS NOT NULL"))
