"""Stored series at several frequencies: which bucket serves a request, and single points across buckets.

A bucket is one (series_id, freq_ms) of a table (series_id, freq_ms, t_ms, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .resample import resample

K = "series_id"


def select_bucket(buckets: DataFrame, requests: DataFrame, finest_first: bool = False) -> DataFrame:
    """The requests (series_id, a, b, cap) with the frequency that serves each: one that covers a to b and is no coarser than cap.

    Analysis takes the coarsest such bucket, raw reads the finest. A request that no bucket serves is left out.
    """
    covered = buckets.groupBy(K, "freq_ms").agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))
    pick = F.min if finest_first else F.max
    fit = requests.join(covered, K).where("freq_ms <= cap AND lo <= a AND hi >= b")
    return fit.groupBy(*requests.columns).agg(pick("freq_ms").alias("freq_ms"))


def grid_requests(grid: DataFrame, any_spacing: bool = False) -> DataFrame:
    """One request for each series of a grid: its range, and as cap its least spacing (or none)."""
    none = F.lit(2**62)
    step = F.col("t_ms") - F.lag("t_ms").over(W.partitionBy(K).orderBy("t_ms"))
    cap = none if any_spacing else F.coalesce(F.min("step"), none)
    return grid.withColumn("step", step).groupBy(K).agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b"), cap.alias("cap"))


def read(buckets: DataFrame, chosen: DataFrame) -> DataFrame:
    """The bars of chosen buckets within their requests."""
    return chosen.select(K, "freq_ms", "a", "b").join(buckets, [K, "freq_ms"]).where("t_ms BETWEEN a AND b").select(K, "freq_ms", "t_ms", "value")


def on_grid(buckets: DataFrame, grid: DataFrame, how: str) -> DataFrame:
    """A grid served from stored buckets: "exact" from one that resolves the grid, other ways from the coarsest that covers it."""
    chosen = select_bucket(buckets, grid_requests(grid, any_spacing=how != "exact"))
    served = grid.join(chosen.select(K), K, "left_semi")
    return resample(read(buckets, chosen).select(K, "t_ms", "value"), served, how)


def points(buckets: DataFrame, asks: DataFrame, exact_only: bool = False) -> DataFrame:
    """Asks (series_id, t_ms) with a value: an exact bar of any bucket, else the last bar before, the finest bucket first.

    ``error`` says which asks have none; with ``exact_only`` earlier bars do not count.
    """
    exact = asks.join(buckets, [K, "t_ms"]).groupBy(K, "t_ms").agg(F.min_by("value", "freq_ms").alias("value"))
    found = asks.join(exact, [K, "t_ms"], "left")
    if not exact_only:
        each = asks.join(buckets.select(K, "freq_ms").distinct(), K)
        before = resample(buckets, each, "latest", [K, "freq_ms"], strict_lookback=True).where("value IS NOT NULL")
        finest = before.groupBy(K, "t_ms").agg(F.min_by("value", "freq_ms").alias("earlier"))
        found = found.join(finest, [K, "t_ms"], "left").withColumn("value", F.coalesce("value", "earlier")).drop("earlier")
    what = "no exact data for " if exact_only else "no data for "
    said = F.concat(F.lit(what), F.col(K).cast("string"), F.lit(" at "), F.col("t_ms").cast("string"))
    return found.withColumn("error", F.when(F.col("value").isNull(), said))
