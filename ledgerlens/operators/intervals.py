"""Points in half-open segments of their key: a join by time bins with an exact check, never an inequality join.

A segment (keys, begin, end) holds begin <= t < end; a null end is open. Segments are laid on the bins that they share with
the points of their key, so an open one ends with the last of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_segments(points: DataFrame, segments: DataFrame, keys: Sequence[str], bin_ms: int) -> DataFrame:
    """(point columns, segment columns) of all pairs in which a segment holds a point; shorter bins mean fewer rows to check, and more rows a segment."""
    keys = list(keys)
    span = points.groupBy(*keys).agg(F.min("t_ms").alias("_lo"), F.max("t_ms").alias("_hi"))
    known = segments.join(span, keys)
    first, last = F.greatest("begin", "_lo"), F.least(F.coalesce(F.col("end") - 1, F.col("_hi")), F.col("_hi"))
    laid = known.withColumns({"_a": first, "_b": last}).where("_a <= _b")
    laid = laid.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / bin_ms), F.floor(F.col("_b") / bin_ms)))).drop("_lo", "_hi", "_a", "_b")
    met = points.withColumn("_bin", F.floor(F.col("t_ms") / bin_ms)).join(laid, [*keys, "_bin"])
    return met.where("t_ms >= begin AND (end IS NULL OR t_ms < end)").drop("_bin")


def segment_mask(points: DataFrame, segments: DataFrame, keys: Sequence[str], bin_ms: int) -> DataFrame:
    """(keys, t_ms, mask, n_segments): 1 where a segment holds the point, and how many do.

    The segments that hold a point are those begun by then less those ended: each is two rows, however long it lasts. Rows are
    summed in order within a bin of their key, after one row with what the earlier bins come to. Nothing is joined, so no side
    is taken for small and sent to the driver.
    """
    keys = list(keys)
    real = segments.where(" AND ".join(["begin IS NOT NULL", "(end IS NULL OR begin < end)", *[f"`{k}` IS NOT NULL" for k in keys]]))
    row = lambda df, t, n, point: df.select(*keys, F.floor(F.col(t) / bin_ms).alias("_bin"), F.col(t).cast("long").alias("t_ms"), F.lit(n).cast("long").alias("_n"), F.lit(point).alias("_point"))
    rows = row(points, "t_ms", 0, True).unionByName(row(real, "begin", 1, False)).unionByName(row(real.where("end IS NOT NULL"), "end", -1, False))
    earlier = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_bin").agg(F.sum("_n").alias("n")).select(*keys, "_bin", F.lit(None).cast("long").alias("t_ms"), F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("_n"), F.lit(False).alias("_point"))
    # The null time of a start comes first; all rows of an instant count at its points.
    held = F.sum("_n").over(W.partitionBy(*keys, "_bin").orderBy("t_ms").rangeBetween(W.unboundedPreceding, W.currentRow))
    out = rows.unionByName(starts).withColumn("n_segments", held).where("_point")
    return out.select(*keys, "t_ms", F.when(F.col("n_segments") > 0, 1).otherwise(0).alias("mask"), "n_segments")
