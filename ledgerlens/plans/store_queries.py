"""Registered queries that write to the shared folder, by batch or stream, and read back what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain as C
from ..operators import ledger as L
from ..operators import models as M
from ..sources import files
from ..sources.folders import forget, shared_folder, stored
from ..sources.ledger_store import LedgerStore, assigned
from ..sources.segments import SeriesStore
from ..streaming import jobs
from . import views as V
from .core_queries import K, r6
from .portfolio_queries import MID, PID
from .views import DAY, HOUR, sql

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, run, oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


def _saved(spark, d) -> DataFrame:
    path = shared_folder(spark)
    files.save_series(V.buckets(spark, d), path)
    return spark.read.parquet(path).select(K, F.col("freq_ms").cast("long").alias("freq_ms"), "t_ms", "value")


add("series_save", _saved, sql("sb", "SELECT series_id, CAST(freq_ms AS BIGINT) AS freq_ms, t_ms, value FROM sb"))


def _snapshots(spark, d) -> str:
    path = shared_folder(spark)
    files.write_snapshots(L.holdings(V.txns(spark, d)), path)
    return path


add("snapshot_write", lambda spark, d: spark.read.parquet(_snapshots(spark, d)).select(PID, "t_ms", F.size("positions").cast("long").alias("n_positions"), F.size("cash").cast("long").alias("n_cash")), sql("hold", "SELECT portfolio_id, t_ms, count(*) FILTER (asset NOT LIKE 'CASH:%') AS n_positions, count(*) FILTER (asset LIKE 'CASH:%') AS n_cash FROM hold GROUP BY 1, 2"))
_HOLD = sql("hold", "SELECT portfolio_id, asset, t_ms, round(quantity, 2) + 0.0 AS quantity FROM hold")
add("snapshot_read", lambda spark, d: r6(files.read_snapshots(spark, _snapshots(spark, d)), "quantity", n=2).select(PID, "asset", "t_ms", "quantity"), _HOLD)


#: Parts and days of a segment for tables of this size.
SEGMENTS = (4, 730)

# Changes of a stored ledger: late inserts, deletes and edits at mixed times, from another time on in each portfolio.
_LATE_FROM = f"t_ms >= {MID} + CAST(portfolio_id AS BIGINT) * {20 * DAY}"
_day = lambda n, k: f"(CAST(floor(t_ms / {DAY}) AS BIGINT) % {n} = {k})"
INSERTED = f"({_LATE_FROM} AND {_day(5, 0)})"
DELETED = f"({_LATE_FROM} AND NOT {_day(5, 0)} AND {_day(11, 3)} AND type <> 'Split')"
EDITED = f"({_LATE_FROM} AND NOT {_day(5, 0)} AND NOT {_day(11, 3)} AND {_day(13, 4)} AND type = 'Deposit')"


def _changed(spark, d, inserts=True, deletes=True, edits=True, own_ids=False) -> LedgerStore:
    """A ledger built without the late rows, then changed once."""
    given = shared_folder(spark)
    log = V.stored_txns(spark, d, given)
    store = LedgerStore(spark, shared_folder(spark), *SEGMENTS)
    store.change(0, log.where(f"NOT {INSERTED}") if inserts else log)
    adds = log.where(INSERTED if inserts else "false")
    adds = assigned(adds) if own_ids else adds
    gone = " OR ".join([DELETED] * deletes + [EDITED] * edits)
    if edits:
        adds = adds.unionByName(log.where(EDITED).withColumns({"id": F.concat("id", F.lit("-v2")), "quantity": F.col("quantity") + 1}))
    store.change(1, adds, log.where(gone).select(PID, "id") if gone else None)
    forget(spark, given)
    return store


def _over(edited: str, body: str, parts: str = "hold") -> str:
    """The ledger's SQL over a changed log."""
    text = sql(parts, body)
    return text.replace("tp AS (SELECT *, CASE type", f"edited AS ({edited}),\ntp AS (SELECT *, CASE type").replace("ELSE 5 END AS pr FROM txn)", "ELSE 5 END AS pr FROM edited)")


_CHAIN = """SELECT CAST(i.portfolio_id AS BIGINT) AS portfolio_id, i.t_ms, count(*) FILTER (a.asset NOT LIKE 'CASH:%') AS n_positions, count(*) FILTER (a.asset LIKE 'CASH:%') AS n_cash,
CAST(coalesce(sum(CAST(h.quantity AS DECIMAL(28,4))) FILTER (a.asset NOT LIKE 'CASH:%'), 0) AS DOUBLE) AS shares, CAST(coalesce(sum(CAST(h.quantity AS DECIMAL(28,4))) FILTER (a.asset LIKE 'CASH:%'), 0) AS DOUBLE) AS cash
FROM (SELECT DISTINCT portfolio_id, t_ms FROM hold) i JOIN (SELECT portfolio_id, asset, min(t_ms) AS f FROM hold GROUP BY 1, 2) a ON i.portfolio_id = a.portfolio_id AND i.t_ms >= a.f
ASOF JOIN hold h ON i.portfolio_id = h.portfolio_id AND a.asset = h.asset AND i.t_ms >= h.t_ms GROUP BY 1, 2"""
_ALL_CHANGES = f"SELECT portfolio_id, t_ms, type, ticker, CASE WHEN {EDITED} THEN quantity + 1 ELSE quantity END AS quantity, price, fee, currency, CASE WHEN {EDITED} THEN id || '-v2' ELSE id END AS id FROM txn WHERE NOT {DELETED}"
_OWN_IDS = f"SELECT * REPLACE (CASE WHEN {INSERTED} THEN 'tx-' || substr(sha256(concat_ws('|', portfolio_id, t_ms, type, coalesce(ticker, ''), id)), 1, 24) ELSE id END AS id) FROM txn"
add("snapshot_rebuild", lambda spark, d: C.summary(_changed(spark, d).snapshots()), _over(_ALL_CHANGES, _CHAIN))
add("snapshot_replace_from", lambda spark, d: _changed(spark, d, inserts=False, edits=False).snapshots().select(PID, "t_ms", "made"), _over(f"SELECT * FROM txn WHERE NOT {DELETED}", f"SELECT CAST(portfolio_id AS BIGINT) AS portfolio_id, t_ms, CAST(coalesce(t_ms >= since, false) AS BIGINT) AS made FROM (SELECT DISTINCT portfolio_id, t_ms FROM hold) LEFT JOIN (SELECT portfolio_id, min(t_ms) AS since FROM txn WHERE {DELETED} GROUP BY 1) USING (portfolio_id)"))
add("txn_add", lambda spark, d: C.summary(_changed(spark, d, deletes=False, edits=False, own_ids=True).snapshots()), _over(_OWN_IDS, _CHAIN))
add("txn_delete", lambda spark, d: C.summary(_changed(spark, d, inserts=False, edits=False).snapshots()), _over(f"SELECT * FROM txn WHERE NOT {DELETED}", _CHAIN))
add("txn_update", lambda spark, d: _changed(spark, d, inserts=False, deletes=False).log().select(PID, "id", "t_ms", "quantity"), sql("txn", f"SELECT CAST(portfolio_id AS BIGINT) AS portfolio_id, CASE WHEN {EDITED} THEN id || '-v2' ELSE id END AS id, t_ms, CASE WHEN {EDITED} THEN quantity + 1 ELSE quantity END AS quantity FROM txn"))


def _opened(spark, d) -> DataFrame:
    """Portfolios that open with ten of every asset they ever trade and with initial capital in two parts."""
    log = V.txns(spark, d)
    positions = log.where("ticker IS NOT NULL").select(PID, F.col("ticker").alias("asset"), F.lit(10.0).alias("quantity")).distinct()
    capital = log.select(PID).distinct().select(PID, F.lit("USD").alias("currency"), F.explode(F.array(F.lit(1000.0), F.lit(500.0))).alias("amount"))
    return r6(L.build(log, positions, capital), "quantity", n=2)


_OPENING = f"SELECT * FROM txn UNION ALL SELECT DISTINCT portfolio_id, {-(2**62)}, 'Buy', ticker, 10.0, 0.0, 0.0, NULL, 'o-' || ticker FROM txn WHERE ticker IS NOT NULL UNION ALL SELECT DISTINCT portfolio_id, {-(2**62)}, 'Deposit', NULL, 1500.0, 0.0, 0.0, 'USD', 'o-cash' FROM txn"
add("portfolio_build_from_opening", _opened, _over(_OPENING, "SELECT portfolio_id, asset, round(arg_max(quantity, t_ms), 2) + 0.0 AS quantity FROM hold WHERE asset IS NOT NULL GROUP BY 1, 2"))


def _paid_abroad(spark, d) -> DataFrame:
    """The cash of logs in which some purchases are paid in euros, at a price of their own."""
    abroad = (F.col("type") == "Buy") & (F.col("quantity") % 5 == 0)
    log = V.txns(spark, d).withColumns({"used_currency": F.when(abroad, F.lit("EUR")), "payment_price": F.when(abroad, F.col("quantity") * F.col("price") * 0.9)})
    return r6(L.cash(log).groupBy(PID, "currency").agg(F.count("*").alias("n"), F.sum(F.col("delta").cast(L.MONEY)).cast("double").alias("balance")), "balance", n=2)


_ABROAD = "type = 'Buy' AND quantity % 5 = 0"
add("ledger_cash_other_currency", _paid_abroad, sql("cd", "SELECT portfolio_id, currency, count(*) AS n, round(CAST(sum(CAST(delta AS DECIMAL(28,4))) AS DOUBLE), 2) + 0.0 AS balance FROM cd GROUP BY 1, 2").replace("id, currency, CASE WHEN type = 'Buy' THEN", f"id, CASE WHEN {_ABROAD} THEN 'EUR' ELSE currency END AS currency, CASE WHEN {_ABROAD} THEN -(quantity * price * 0.9::DOUBLE) WHEN type = 'Buy' THEN"))


def _in_waves(df: DataFrame, waves: int, path: str, start) -> None:
    """Rows of a stored table in the order of their ``wave``: each wave is written to the stream's folder, worked off and deleted before the next one comes."""
    session, schema = df.sparkSession, df.drop("wave").schema
    for n in range(waves):
        stored(df.where(F.col("wave") == n).drop("wave"), f"{path}/in", mode="append")
        start(session.readStream.schema(schema).parquet(f"{path}/in")).awaitTermination()
        forget(session, f"{path}/in")


def _upserted(spark, d) -> DataFrame:
    """Ticks in three waves; some are corrected in the next one, and for some an older value comes two waves late."""
    path = shared_folder(spark)
    ticks = V.table(spark, d, "events").select(F.col("user_id").alias(K), V.ms("ts").alias("t_ms"), "value", "event_id", (F.col("event_id") % 3).alias("arrived"))
    row = lambda df, value, later, wave: df.select(K, "t_ms", value.alias("value"), (F.col("arrived") + later).alias("arrived"), (F.col("arrived") + wave).cast("int").alias("wave"))
    x = F.col("value")
    every = row(ticks, x, 0, 0).unionByName(row(ticks.where("event_id % 5 = 0"), x * 2, 1, 1)).unionByName(row(ticks.where("event_id % 7 = 0"), x - 1, -1, 2))
    _in_waves(stored(every, f"{path}/all", "wave"), 5, path, lambda stream: jobs.upsert_series(stream, f"{path}/table", f"{path}/state"))
    return SeriesStore(spark, f"{path}/table").read().select(K, "t_ms", "value")


def _repaired(spark, d) -> DataFrame:
    """The log in three waves: later ones hold late transactions of all times from the middle on, and rows that were sent before."""
    path = shared_folder(spark)
    log = V.stored_txns(spark, d, f"{path}/given")
    day = F.floor(F.col("t_ms") / DAY) % 4
    wave = F.when((F.col("t_ms") < MID) | (day < 2), 0).otherwise(day - 1).cast("int")
    again = log.where((F.col("t_ms") >= MID) & (day == 0)).withColumn("wave", F.lit(2))
    _in_waves(log.withColumn("wave", wave).unionByName(again), 3, path, lambda stream: jobs.repair_ledger(stream, f"{path}/ledger", f"{path}/state", *SEGMENTS))
    forget(spark, f"{path}/given")
    return C.summary(LedgerStore(spark, f"{path}/ledger", *SEGMENTS).snapshots())


_EVENTS = "SELECT user_id AS series_id, epoch_us(ts) // 1000 AS t_ms, value, event_id, event_id % 3 AS arrived FROM events"
add("stream_series_upsert", _upserted, f"WITH e AS ({_EVENTS}), u AS (SELECT series_id, t_ms, value, arrived FROM e UNION ALL SELECT series_id, t_ms, value * 2, arrived + 1 FROM e WHERE event_id % 5 = 0 UNION ALL SELECT series_id, t_ms, value - 1, arrived - 1 FROM e WHERE event_id % 7 = 0) SELECT series_id, t_ms, arg_max(value, (arrived, value)) AS value FROM u GROUP BY 1, 2")
add("stream_ledger", _repaired, sql("hold", _CHAIN))

# Forecasts of the last two fifths of each event type's hourly means, met by actuals that are early or late by a minute, come a wave late, twice, or never.
HORIZON, LAST_N, LIMIT, TOLERANCE, PATIENCE = 300, 20, 60.0, 300_000, DAY
_WAVES = 5


def _actuals(rest: DataFrame) -> DataFrame:
    """Arrivals (series_id, t_ms, value, wave) of ticks with the k-th hour after training."""
    h = F.floor(F.col("t_ms") / HOUR)
    late = F.when(h % 7 == 3, 1).when(h % 11 == 5, 2).otherwise(0)
    base = rest.withColumn("wave", (F.least(F.lit(2), F.floor(F.col("k") / 96)) + late).cast("int"))
    base = base.where(h % 13 != 6).withColumn("t_ms", F.col("t_ms") + (h % 3 - 1) * 60_000).select(K, "t_ms", "value", "wave", (h % 5 == 2).alias("twice"))
    again = base.where("twice").withColumns({"value": F.col("value") + 1, "wave": F.least(F.col("wave") + 1, F.lit(_WAVES - 1))})
    return base.unionByName(again).drop("twice")


def _monitored_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    """(models with their last training values, arrivals)."""
    parts = M.split(V.by_type(spark, d))
    train = parts.where("part = 'train'").drop("part")
    ends = train.groupBy(K).agg(F.max("t_ms").alias("t0"), F.array(F.max_by("value", "t_ms")).alias("context"))
    models = M.fit_ols(train, 1).select(K, "c", "phi").join(ends, K).withColumn("dt", F.lit(HOUR).cast("long"))
    rest = parts.where("part <> 'train'").join(ends.select(K, "t0"), K).withColumn("k", (F.col("t_ms") - F.col("t0")) / HOUR)
    return models, _actuals(rest)


def _monitored(spark, d) -> DataFrame:
    path, session = shared_folder(spark), spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    models, arrivals = _monitored_tables(session, d)
    models.write.parquet(f"{path}/models")
    models = session.read.parquet(f"{path}/models")

    def start(stream: DataFrame):
        seen = jobs.monitor_forecasts(stream, models, HORIZON, LAST_N, LIMIT, TOLERANCE, PATIENCE)
        return seen.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()

    _in_waves(stored(arrivals, f"{path}/all", "wave"), _WAVES, path, start)
    out = spark.read.schema(jobs.MONITORED).parquet(f"{path}/out")
    return r6(out, "predicted", "actual", "rolling_mse", n=4)


_MONITOR = f"""
p AS (SELECT series_id, t_ms, value, row_number() OVER (PARTITION BY series_id ORDER BY t_ms) - 1 < floor(count(*) OVER (PARTITION BY series_id) * 0.6) AS train FROM st),
x AS (SELECT series_id, t_ms, value AS y, lag(value) OVER (PARTITION BY series_id ORDER BY t_ms) AS x1 FROM p WHERE train),
m AS (SELECT series_id, regr_slope(y, x1) AS phi, regr_intercept(y, x1) AS c, max(t_ms) AS t0, arg_max(y, t_ms) AS y0 FROM x GROUP BY 1),
fc AS (SELECT series_id, t0 + k * {HOUR} AS ft, c / (1 - phi) + phi ** k * (y0 - c / (1 - phi)) AS predicted FROM m, range(1, {HORIZON + 1}) q(k)),
r AS (SELECT p.series_id, t_ms, value, t_ms // {HOUR} AS h, least(2, ((t_ms - t0) // {HOUR}) // 96) + CASE WHEN (t_ms // {HOUR}) % 7 = 3 THEN 1 WHEN (t_ms // {HOUR}) % 11 = 5 THEN 2 ELSE 0 END AS wave FROM p JOIN m USING (series_id) WHERE NOT train),
b AS (SELECT series_id, t_ms + (h % 3 - 1) * 60000 AS t_ms, value, wave, h FROM r WHERE h % 13 <> 6),
a AS (SELECT series_id, t_ms, value, wave FROM b UNION ALL SELECT series_id, t_ms, value + 1, least(wave + 1, {_WAVES - 1}) FROM b WHERE h % 5 = 2),
w AS (SELECT series_id, wave, max(max(t_ms)) OVER (PARTITION BY series_id ORDER BY wave) AS after, max(max(t_ms)) OVER (PARTITION BY series_id ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a GROUP BY 1, 2),
n AS (SELECT a.series_id, wave, t_ms, value, t0 + CAST(round((t_ms - t0) / {HOUR}) AS BIGINT) * {HOUR} AS ft, before FROM a JOIN m USING (series_id) JOIN w USING (series_id, wave)),
g AS (SELECT series_id, ft, min({{'w': wave, 't': t_ms, 'v': value}}) AS f FROM n WHERE abs(t_ms - ft) <= {TOLERANCE} AND (before IS NULL OR ft + {TOLERANCE} >= before - {PATIENCE}) GROUP BY 1, 2),
mt AS (SELECT fc.series_id, fc.ft, predicted, f.v AS actual, f.w AS wave FROM fc JOIN g USING (series_id, ft)),
dr AS (SELECT fc.series_id, fc.ft, predicted, min(w.wave) AS wave FROM fc JOIN w USING (series_id) WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.series_id = fc.series_id AND mt.ft = fc.ft) AND fc.ft + {TOLERANCE} < w.after - {PATIENCE} GROUP BY 1, 2, 3),
e AS (SELECT series_id, wave, avg(x) AS mse FROM (SELECT w.series_id, w.wave, (actual - predicted) ** 2 AS x, row_number() OVER (PARTITION BY w.series_id, w.wave ORDER BY mt.ft DESC) AS k FROM w JOIN mt ON w.series_id = mt.series_id AND mt.wave <= w.wave) WHERE k <= {LAST_N} GROUP BY 1, 2),
z AS (SELECT series_id, ft, 'matched' AS status, predicted, actual, wave FROM mt UNION ALL SELECT series_id, ft, 'dropped', predicted, NULL, wave FROM dr)"""
add("stream_forecast_monitor", _monitored, sql("st", f"SELECT series_id, ft AS t_ms, status, round(predicted, 4) + 0.0 AS predicted, round(actual, 4) + 0.0 AS actual, round(mse, 4) + 0.0 AS rolling_mse, coalesce(mse > {LIMIT}, false) AS refit FROM z LEFT JOIN e USING (series_id, wave)").replace("\nSELECT", f",{_MONITOR}\nSELECT", 1))
