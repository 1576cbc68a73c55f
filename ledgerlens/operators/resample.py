"""Grids, resampling and as-of joins by union and window: one shuffle by key, no inequality join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .series import KEY


def grid_regular(ranges: DataFrame, step: int, begin: str = "begin", end: str = "end") -> DataFrame:
    """begin, begin + step, ... <= end for each row of ``ranges``, as t_ms."""
    if step <= 0:
        raise ValueError("step must be positive")
    keep = [c for c in ranges.columns if c not in (begin, end)]
    return ranges.select(*keep, F.explode(F.sequence(F.col(begin), F.col(end), F.lit(step).cast("long"))).alias("t_ms"))


def neighbours(bars: DataFrame, grid: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Grid rows with the bar at or before (lt, lv) and the next one after (rt, rv)."""
    rows = bars.select(*keys, "t_ms", F.struct(F.col("t_ms").alias("t"), F.col("value").alias("v")).alias("b")).unionByName(
        grid.select(*keys, "t_ms", F.lit(None).cast("struct<t:bigint,v:double>").alias("b"))
    )
    w = W.partitionBy(*keys).orderBy("t_ms", F.col("b").isNull())
    both = rows.select(
        *keys, "t_ms", "b",
        F.last("b", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("l"),
        F.first("b", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("r"),
    )
    return both.where("b IS NULL").select(*keys, "t_ms", F.col("l.t").alias("lt"), F.col("l.v").alias("lv"), F.col("r.t").alias("rt"), F.col("r.v").alias("rv"))


def resample(bars: DataFrame, grid: DataFrame, how: str = "latest", keys: Sequence[str] = KEY, strict_lookback: bool = False) -> DataFrame:
    """Values on a grid: latest, linear, nearest (ties go right) or exact.

    Ticks before the first bar take it, ticks after the last bar keep it; ``strict_lookback`` leaves the former null.
    """
    if how == "exact":
        return grid.select(*keys, "t_ms").join(bars.select(*keys, "t_ms", "value"), [*keys, "t_ms"], "left")
    lt, lv, rt, rv, t = (F.col(c) for c in ("lt", "lv", "rt", "rv", "t_ms"))
    inside = {
        "latest": lv,
        "linear": lv + (t - lt) / (rt - lt) * (rv - lv),
        "nearest": F.when(t - lt < rt - t, lv).otherwise(rv),
    }[how]
    first = F.lit(None).cast("double") if strict_lookback else rv
    value = F.when(lt.isNull(), first).when((lt == t) | rt.isNull(), lv).otherwise(inside)
    return neighbours(bars, grid, keys).select(*keys, "t_ms", value.alias("value"))


def step_series(breakpoints: DataFrame, grid: DataFrame, fill_before: float = 0.0, order: str = "seq", keys: Sequence[str] = KEY) -> DataFrame:
    """A step function on the grid; of equal breakpoints the last by ``order`` wins."""
    last = breakpoints.groupBy(*keys, "t_ms").agg(F.max_by("value", order).alias("value"))
    return resample(last, grid, "latest", keys, strict_lookback=True).withColumn("value", F.coalesce("value", F.lit(float(fill_before))))


def stochastic(bars: DataFrame, grid: DataFrame, rate: float, seed: int = 42, keys: Sequence[str] = KEY) -> DataFrame:
    """Linear values plus bridge noise whose variance vanishes at the bars; the noise is a hash of (seed, key, tick)."""
    lt, lv, rt, rv, t = (F.col(c) for c in ("lt", "lv", "rt", "rv", "t_ms"))
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *keys, "t_ms"), 12).cast("double") + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * F.pi() * unit(2))
    inside = lv + (t - lt) / (rt - lt) * (rv - lv) + F.sqrt(F.lit(rate) * (t - lt) * (rt - t) / (rt - lt)) * normal
    value = F.when(lt.isNull(), rv).when((lt == t) | rt.isNull(), lv).otherwise(inside)
    return neighbours(bars, grid, keys).select(*keys, "t_ms", value.alias("value"))


def variance_rate(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Sum of squared steps by elapsed time; 0 below two bars."""
    d = F.col("value") - F.lag("value").over(W.partitionBy(*keys).orderBy("t_ms"))
    span = F.max("t_ms") - F.min("t_ms")
    return bars.withColumn("_d", d * d).groupBy(*keys).agg(F.when(span == 0, F.lit(0.0)).otherwise(F.coalesce(F.sum("_d"), F.lit(0.0)) / span).alias("variance_rate"))


def grid_union(grids: DataFrame) -> DataFrame:
    return grids.select("t_ms").distinct()


def grid_intersection(grids: DataFrame, source: str, n: int) -> DataFrame:
    """Ticks that all n sources hold."""
    return grids.groupBy("t_ms").agg(F.countDistinct(source).alias("_n")).where(F.col("_n") == n).select("t_ms")


def regularity(bars: DataFrame, tolerance: float = 0.05, keys: Sequence[str] = KEY) -> DataFrame:
    """Upper median and population deviation of the steps; regular if the latter is small. Under 3 points: regular."""
    own = W.partitionBy(*keys)
    d = (F.col("t_ms") - F.lag("t_ms").over(own.orderBy("t_ms"))).cast("double")
    # The median is the step at one place of the ordered steps: no list of them is gathered.
    placed = bars.select(*keys, d.alias("_d")).withColumn("_k", F.row_number().over(own.orderBy(F.col("_d").asc_nulls_last())) - 1).withColumn("_n", F.count("_d").over(own))
    out = placed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2), F.col("_d"))).alias("median_step"), F.stddev_pop("_d").alias("sd_step"),
    )
    return out.withColumn("regular", (F.col("n") < 3) | (F.col("sd_step") <= F.greatest(F.lit(tolerance) * F.col("median_step"), F.lit(1.0))))
