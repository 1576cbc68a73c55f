"""Algebra and transforms of long series tables (key columns, t_ms, value).

Values that are null, NaN or infinite count as missing; every aggregate drops them first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("series_id",)


def finite(c: Column) -> Column:
    """True for a value that is neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def over(keys: Sequence[str] = KEY, t: str = "t_ms"):
    """Rows of a series in time order."""
    return W.partitionBy(*keys).orderBy(t)


def divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


OPS = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divide}


def combine(left: DataFrame, right: DataFrame, op: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Elementwise ``op`` of two series tables on (keys, t_ms)."""
    on = [*keys, "t_ms"]
    return left.select(*on, F.col("value").alias("_a")).join(right.select(*on, F.col("value").alias("_b")), on).select(*on, OPS[op](F.col("_a"), F.col("_b")).alias("value"))


def misaligned(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Per series, ticks found on one side only; series that agree are absent."""
    on = [*keys, "t_ms"]
    both = left.select(*on, F.lit(1).alias("_l")).join(right.select(*on, F.lit(1).alias("_r")), on, "full")
    return both.groupBy(*keys).agg(F.count(F.when(F.col("_l").isNull() | F.col("_r").isNull(), 1)).alias("n_misaligned")).where("n_misaligned > 0")


def scalar(df: DataFrame, op: str, x: float) -> DataFrame:
    """``op`` with a number; division by 0 is an error."""
    if op == "div" and x == 0:
        raise ZeroDivisionError("series divided by 0")
    return df.withColumn("value", OPS[op](F.col("value"), F.lit(float(x))))


def shift(df: DataFrame, n: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Values n ticks earlier at the same ticks; ticks without such a value go."""
    return df.withColumn("value", F.lag("value", n).over(over(keys))).withColumn("_r", F.row_number().over(over(keys))).where(F.col("_r") > n).drop("_r")


def positions(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Add ``pos``, counted from 0 within each series."""
    return df.withColumn("pos", F.row_number().over(over(keys)) - 1)


def bounds(df: DataFrame, t: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Positions of the first tick >= t and of the first tick > t."""
    return df.groupBy(*keys).agg(F.count_if(F.col("t_ms") < t).alias("lower"), F.count_if(F.col("t_ms") <= t).alias("upper"))


def returns(df: DataFrame, kind: str = "log", keys: Sequence[str] = KEY) -> DataFrame:
    """Log or simple returns; missing where prices do not allow one; the first tick goes."""
    before, now = F.lag("value").over(over(keys)), F.col("value")
    out = F.when((before > 0) & (now > 0), F.ln(now / before)) if kind == "log" else F.when((before > 0) & (now >= 0), (now - before) / before)
    return df.withColumn("_r", F.row_number().over(over(keys))).withColumn("value", out).where("_r > 1").drop("_r")


def zscores(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Add ``z``: distance from the mean in population deviations, 0 where these are below 1e-9."""
    w = W.partitionBy(*keys)
    sd = F.stddev_pop("value").over(w)
    return df.withColumn("z", F.when(sd < 1e-9, F.lit(0.0)).otherwise((F.col("value") - F.avg("value").over(w)) / sd))


def ends(df: DataFrame, n: int, last: bool = False, keys: Sequence[str] = KEY) -> DataFrame:
    """The first (or last) n rows of each series."""
    w = W.partitionBy(*keys).orderBy(F.col("t_ms").desc() if last else F.col("t_ms"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Upsert by (keys, t_ms): the newer batch wins, and no new rows change nothing."""
    both = old.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)))
    value = [c for c in old.columns if c not in (*keys, "t_ms")]
    return both.groupBy(*keys, "t_ms").agg(F.max_by(F.struct(*value), "_b").alias("_v")).select(*keys, "t_ms", "_v.*")


def duration_label(ms: Column) -> Column:
    """The two largest units of a duration, such as 1d or 4h48m."""
    parts, rest = [], ms
    for unit, size in (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000)):
        n = F.floor(rest / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))))
        rest = rest % size
    parts.append(F.when(rest > 0, F.concat(rest.cast("string"), F.lit("ms"))))
    found = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return F.when(F.size(found) == 0, F.lit("0ms")).otherwise(F.array_join(F.slice(found, 1, 2), ""))
