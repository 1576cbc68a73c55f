"""Incremental counterparts as Structured Streaming: series upserts, forecast monitoring and ledger repair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.ledger_store import LedgerStore
from ..sources.segments import SeriesStore


def _each_batch(stream: DataFrame, work, checkpoint: str):
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_series(stream: DataFrame, path: str, checkpoint: str, key_type: str = "bigint", era_days: int = 7):
    """Merge each micro-batch (series_id, t_ms, value, arrived) into a stored table; the value that arrived last wins. Returns the query.

    A batch rewrites only the segments of keys and times that it touches, and is a commit of its number, so a batch that is
    run again changes nothing.
    """
    return _each_batch(stream, lambda batch, n: SeriesStore(batch.sparkSession, path, key_type, era_days=era_days).upsert(n, batch), checkpoint)


def repair_ledger(stream: DataFrame, path: str, checkpoint: str, parts: int = 16, era_days: int = 365):
    """Append new transactions by id and renew the snapshots of the portfolios that a batch touches, from its earliest one on.

    Late transactions are repaired from their time: the replay begins at the stored snapshot before them.
    """
    return _each_batch(stream, lambda batch, n: LedgerStore(batch.sparkSession, path, parts, era_days).change(n, adds=batch), checkpoint)


MONITORED = "series_id string, t_ms long, status string, predicted double, actual double, rolling_mse double, refit boolean"


class ForecastMonitor(StatefulProcessor):
    """Outstanding forecasts of a fitted model by series, matched with the actuals that arrive.

    The first row of a series issues the forecasts t0 + k dt, k = 1..horizon. An actual within ``tolerance`` of an outstanding one
    settles it; later ones for the same forecast are repeats and change nothing. Once the series has been seen ``patience``
    beyond a forecast, it is dropped. The errors of the ``last_n`` latest settled forecasts give the rolling error, and ``refit`` tells
    that it is above ``limit``.
    """

    def __init__(self, horizon: int, last_n: int, limit: float, tolerance: int, patience: int):
        self.horizon, self.last_n, self.limit, self.tolerance, self.patience = horizon, last_n, limit, tolerance, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", "t long", "predicted double")
        self.errors = handle.getMapState("errors", "t long", "error double")
        self.seen = handle.getValueState("seen", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["t_ms", "value"])
        model = rows.iloc[0]
        if not self.seen.exists():
            window = list(model["context"])
            for k in range(1, self.horizon + 1):
                value = float(model["c"] + sum(p * x for p, x in zip(model["phi"], window, strict=True)))
                window = [value, *window[:-1]]
                self.pending.updateValue((int(model["t0"] + k * model["dt"]),), (value,))
        out = []
        for t, value in zip(rows["t_ms"].tolist(), rows["value"].tolist(), strict=True):
            at = int(model["t0"] + round((t - model["t0"]) / model["dt"]) * model["dt"])
            if abs(t - at) <= self.tolerance and self.pending.containsKey((at,)):
                predicted = self.pending.getValue((at,))[0]
                self.pending.removeKey((at,))
                self.errors.updateValue((at,), (value - predicted,))
                out.append((key[0], at, "matched", predicted, value))
        seen = max([int(rows["t_ms"].max()), *(self.seen.get() if self.seen.exists() else ())])
        self.seen.update((seen,))
        for (at,), (predicted,) in sorted((tuple(k), tuple(v)) for k, v in list(self.pending.iterator())):
            if at + self.tolerance < seen - self.patience:
                self.pending.removeKey((at,))
                out.append((key[0], at, "dropped", predicted, None))
        known = sorted(((k[0], v[0]) for k, v in list(self.errors.iterator())), reverse=True)
        for at, _ in known[self.last_n :]:
            self.errors.removeKey((at,))
        last = [e * e for _, e in known[: self.last_n]]
        mse = sum(last) / len(last) if last else None
        shown = pd.DataFrame(out, columns=["series_id", "t_ms", "status", "predicted", "actual"])
        shown["actual"] = shown["actual"].astype(float)
        shown["rolling_mse"], shown["refit"] = mse, bool(last and mse > self.limit)
        yield shown

    def close(self) -> None:
        pass


def monitor_forecasts(stream: DataFrame, models: DataFrame, horizon: int, last_n: int = 20, limit: float = 1.0, tolerance: int = 0, patience: int = 0) -> DataFrame:
    """What becomes of each forecast as actuals (series_id, t_ms, value) arrive; see ``ForecastMonitor``.

    models: series_id, c, phi, context (the last values, newest first), t0, dt. Needs the RocksDB state store.
    """
    joined = stream.join(models.select("series_id", "c", "phi", "context", "t0", "dt"), "series_id")
    return joined.groupBy("series_id").transformWithStateInPandas(ForecastMonitor(horizon, last_n, limit, tolerance, patience), MONITORED, "append", "none")


def batch_monitor(arrivals: DataFrame, forecasts: DataFrame, models: DataFrame, last_n: int = 20, limit: float = 1.0, tolerance: int = 0, patience: int = 0) -> DataFrame:
    """The same from finished tables: arrivals carry the ``wave`` in which they came, forecasts are (series_id, t_ms, predicted)."""
    K = "series_id"
    waves = arrivals.groupBy(K, "wave").agg(F.max("t_ms").alias("top"))
    w = W.partitionBy(K).orderBy("wave")
    clock = waves.select(K, "wave", F.max("top").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.max("top").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("after"))
    placed = arrivals.join(models.select(K, "t0", "dt"), K).withColumn("at", (F.col("t0") + F.round((F.col("t_ms") - F.col("t0")) / F.col("dt")) * F.col("dt")).cast("long"))
    near = placed.where(F.abs(F.col("t_ms") - F.col("at")) <= tolerance).join(clock, [K, "wave"]).where(f"before IS NULL OR at + {tolerance} >= before - {patience}")
    settled = near.groupBy(K, "at").agg(F.min(F.struct("wave", F.col("t_ms").alias("t"), "value")).alias("x")).select(K, F.col("at").alias("t_ms"), "x.wave", F.col("x.value").alias("actual"))
    both = forecasts.join(settled, [K, "t_ms"], "left")
    matched = both.where("wave IS NOT NULL").withColumn("status", F.lit("matched"))
    late = both.where("wave IS NULL").drop("wave").join(clock, K).where(f"t_ms + {tolerance} < after - {patience}")
    dropped = late.groupBy(K, "t_ms", "predicted", "actual").agg(F.min("wave").alias("wave")).withColumn("status", F.lit("dropped"))
    known = waves.select(K, "wave").join(matched.select(K, F.col("t_ms").alias("at"), F.col("wave").alias("came"), (F.col("actual") - F.col("predicted")).alias("e")), K).where("came <= wave")
    newest = known.withColumn("r", F.row_number().over(W.partitionBy(K, "wave").orderBy(F.desc("at")))).where(F.col("r") <= last_n)
    mse = newest.groupBy(K, "wave").agg(F.avg(F.col("e") * F.col("e")).alias("rolling_mse"))
    shown = matched.select(K, "t_ms", "status", "predicted", "actual", "wave").unionByName(dropped.select(K, "t_ms", "status", "predicted", "actual", "wave"))
    return shown.join(mse, [K, "wave"], "left").withColumn("refit", F.coalesce(F.col("rolling_mse") > limit, F.lit(False)))
