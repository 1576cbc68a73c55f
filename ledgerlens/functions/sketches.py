"""Quantiles of long series from mergeable sketches by time bucket, beside the exact form.

A sketch of size k has a rank error of at most ``rank_error(k)`` with 99 % confidence, whatever the number of values, and so
has any merge of sketches: buckets are written once, and later questions merge the few rows that they span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import finite

SIZE = 400


def rank_error(k: int = SIZE) -> float:
    """Share of the values by which the rank of an answer may be off."""
    return 2.296 / k**0.9021


def sketched(df: DataFrame, keys: Sequence[str], bucket_ms: int, k: int = SIZE) -> DataFrame:
    """(keys, bucket, n, sketch) of the finite values, aggregated map-side first."""
    bucket = F.floor(F.col("t_ms") / bucket_ms).alias("bucket")
    return df.where(finite(F.col("value"))).groupBy(*keys, bucket).agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, sketch) over all buckets that are given."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(keys, share, value): one answer for each share."""
    each = F.array(*[F.struct(F.lit(float(p)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in shares])
    return sketches.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")
