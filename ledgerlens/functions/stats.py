"""Aggregate expressions and serial statistics over finite values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.series import KEY, finite

_C = Column | str


def _v(c: _C) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(finite(c), c)


def mean(c: _C) -> Column:
    """Mean, 0 of nothing."""
    return F.coalesce(F.avg(_v(c)), F.lit(0.0))


def variance(c: _C, sample: bool = True) -> Column:
    """Variance; 0 of nothing; the sample variance of one value is null."""
    v = _v(c)
    return F.when(F.count(v) == 0, F.lit(0.0)).otherwise(F.var_samp(v) if sample else F.var_pop(v))


def std(c: _C, sample: bool = True) -> Column:
    return F.sqrt(variance(c, sample))


def skew(c: _C) -> Column:
    """Population skewness, 0 of a constant."""
    v = _v(c)
    return F.when(F.count(v) == 0, F.lit(None)).otherwise(F.when(F.stddev_pop(v) == 0, F.lit(0.0)).otherwise(F.skewness(v)))


def kurtosis(c: _C) -> Column:
    """Fourth standardised moment; 0 of a constant; null below four values."""
    v = _v(c)
    return F.when(F.stddev_pop(v) == 0, F.lit(0.0)).when(F.count(v) >= 4, F.kurtosis(v) + 3)


def excess_kurtosis(c: _C) -> Column:
    return kurtosis(c) - 3


def quantile(c: _C, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(_v(c), F.lit(q))


def cdf(c: _C, x: float) -> Column:
    """Share of values not above x."""
    v = _v(c)
    return F.avg(F.when(v.isNotNull(), (v <= x).cast("double")))


def jarque_bera(c: _C) -> Column:
    v = _v(c)
    s, k = skew(c), excess_kurtosis(c)
    return F.count(v) / 6 * (s * s + k * k / 4)


def volatility(c: _C, per_year: float = 252.0) -> Column:
    return F.stddev_samp(_v(c)) * F.sqrt(F.lit(per_year))


def sharpe(c: _C) -> Column:
    """Mean by sample deviation, without annualisation; 0 where there is no deviation."""
    v = _v(c)
    return F.when(F.stddev_samp(v) == 0, F.lit(0.0)).otherwise(F.avg(v) / F.stddev_samp(v))


def sharpe_annualized(c: _C, per_year: float = 252.0) -> Column:
    return sharpe(c) * F.sqrt(F.lit(per_year))


def total_return(c: _C = "value", t: _C = "t_ms") -> Column:
    """(last - first) / first; null below two points or from 0."""
    first, last = F.min_by(c, t), F.max_by(c, t)
    return F.when((F.count(c) >= 2) & (first != 0), (last - first) / first)


def autocovariance(df: DataFrame, max_lag: int, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, lag, gamma): sums of lagged products about the mean, not normalised, for lags 0..max_lag."""
    df = df.where(finite(F.col("value")))
    w, all_rows = W.partitionBy(*keys).orderBy("t_ms"), W.partitionBy(*keys)
    x = df.select(*keys, "t_ms", (F.col("value") - F.avg("value").over(all_rows)).alias("x"))
    lags = x.select(*keys, *[(F.col("x") * (F.lag("x", k).over(w) if k else F.col("x"))).alias(f"p{k}") for k in range(max_lag + 1)])
    sums = lags.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(f"p{k}") for k in range(max_lag + 1)]).alias("g"))
    return sums.select(*keys, "n", F.posexplode("g").alias("lag", "gamma")).where("lag < n").select(*keys, "lag", "gamma")


def acf(df: DataFrame, max_lag: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Autocorrelations; 0 where the variance is 0."""
    g = autocovariance(df, max_lag, keys)
    g0 = F.max(F.when(F.col("lag") == 0, F.col("gamma"))).over(W.partitionBy(*keys))
    return g.select(*keys, "lag", F.when(g0 == 0, F.lit(0.0)).otherwise(F.col("gamma") / g0).alias("acf"))


def toeplitz(df: DataFrame, k: int, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, i, j, value): the symmetric matrix of autocovariances."""
    g = autocovariance(df, k - 1, keys)
    n = g.select(*keys, "lag", "gamma", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    cells = n.select(*keys, "i", F.explode(F.array_distinct(F.array(F.col("i") + F.col("lag"), F.col("i") - F.col("lag")))).alias("j"), F.col("gamma").alias("value"))
    return cells.where(F.col("j").between(0, k - 1))


def levinson(df: DataFrame, order: int, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, phi, sigma2, reflections): the Durbin recursion over autocovariances, as one fold."""
    g = autocovariance(df, order, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "gamma"))).alias("s")).where(F.size("s") == order + 1)
    g = g.select(*keys, F.transform("s", lambda x: x["gamma"]).alias("g")).where(F.col("g")[0] != 0)

    def step(a: Column, k: Column) -> Column:
        done = F.aggregate(F.zip_with(a["phi"], F.transform(a["phi"], lambda _, i: F.get(F.col("g"), k - 1 - i)), lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
        r = (F.get(F.col("g"), k) - done) / a["sigma2"]
        old = F.zip_with(a["phi"], F.reverse(a["phi"]), lambda p, q: p - r * q)
        return F.struct(F.concat(old, F.array(r)).alias("phi"), (a["sigma2"] * (1 - r * r)).alias("sigma2"), F.concat(a["lam"], F.array(r)).alias("lam"))

    zero = F.struct(F.expr("cast(array() as array<double>)").alias("phi"), F.col("g")[0].alias("sigma2"), F.expr("cast(array() as array<double>)").alias("lam"))
    out = g.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.lit(order)), zero, step))
    return out.select(*keys, F.col("a.phi").alias("phi"), F.col("a.sigma2").alias("sigma2"), F.col("a.lam").alias("reflections"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def toeplitz_solve(first: Column, rhs: Column) -> Column:
    """The solution x of T x = rhs for the symmetric Toeplitz matrix T whose first column is ``first``, as one fold over arrays.

    The fold keeps the vector f with T f = (1, 0, ..., 0) and the solution of each leading part; reversed, f solves for the
    last unit vector, by which both grow by one row.
    """
    zero = F.array(F.lit(0.0))

    def step(a: Column, k: Column) -> Column:
        tail = F.reverse(F.slice(first, 2, k))  # first[k], ..., first[1]
        e = _dot(tail, a["f"])
        scale = 1 - e * e
        f = F.zip_with(F.concat(a["f"], zero), F.concat(zero, F.reverse(a["f"])), lambda x, y: (x - e * y) / scale)
        left = F.get(rhs, k) - _dot(tail, a["x"])
        return F.struct(f.alias("f"), F.zip_with(F.concat(a["x"], zero), F.reverse(f), lambda x, y: x + left * y).alias("x"))

    begin = F.struct(F.array(1 / first[0]).alias("f"), F.array(rhs[0] / first[0]).alias("x"))
    steps = F.when(F.size(rhs) > 1, F.sequence(F.lit(1), F.size(rhs) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, begin, step)["x"]


def yule_walker(df: DataFrame, max_order: int, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, order, c, phi, sigma2, aic, chosen) of orders 1 to ``max_order``: one aggregate a series, then solves over arrays.

    sigma2 is the mean squared innovation that the autocovariances imply; the order of least AIC (the lower of equal ones) is chosen.
    """
    gammas = autocovariance(df, max_order, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "gamma"))).alias("s")).where(F.size("s") == max_order + 1)
    mean_n = df.where(finite(F.col("value"))).groupBy(*keys).agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    g = gammas.select(*keys, F.transform("s", lambda x: x["gamma"]).alias("g")).where(F.col("g")[0] != 0).join(mean_n, list(keys))
    each = g.withColumn("order", F.explode(F.sequence(F.lit(1), F.lit(max_order)))).withColumn("phi", toeplitz_solve(F.expr("slice(g, 1, order)"), F.expr("slice(g, 2, order)")))
    left = (F.col("g")[0] - _dot(F.col("phi"), F.expr("slice(g, 2, order)"))) / F.col("n")
    out = each.withColumn("sigma2", left).withColumn("aic", F.col("n") * F.ln("sigma2") + 2 * (F.col("order") + 1))
    total = F.aggregate("phi", F.lit(0.0), lambda s, x: s + x)
    best = F.min(F.struct("aic", "order")).over(W.partitionBy(*keys))["order"]
    return out.select(*keys, "order", ((1 - total) * F.col("m")).alias("c"), "phi", "sigma2", "aic", (F.col("order") == best).alias("chosen"))


# Coefficients of the usual rational form of erfc, with a relative error of 1.2e-7 at most.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function of a column."""
    z = F.abs(x)
    t = 1 / (1 + z / 2)
    poly = F.lit(_ERFC[-1])
    for a in _ERFC[-2::-1]:
        poly = a + t * poly
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def p_value(t: Column) -> Column:
    """Two-sided, by the normal distribution."""
    return erfc(F.abs(t) / F.sqrt(F.lit(2.0)))


def correlation_matrix(df: DataFrame, key: str = "series_id") -> DataFrame:
    """(a, b, corr) for a <= b over common ticks; 1 on the diagonal, 0 where a side is constant."""
    df = df.where(finite(F.col("value")))
    x = df.select(F.col(key).alias("a"), "t_ms", F.col("value").alias("x"))
    y = df.select(F.col(key).alias("b"), "t_ms", F.col("value").alias("y"))
    flat = (F.stddev_pop("x") == 0) | (F.stddev_pop("y") == 0)
    both = x.join(y, "t_ms").where("a < b").groupBy("a", "b").agg(F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("corr"))
    return both.unionByName(df.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("corr")).distinct())


def correlation_blocks(df: DataFrame, key: str = "series_id", n_blocks: int = 8, chunk_ms: int = 365 * 86_400_000) -> DataFrame:
    """``correlation_matrix`` for many series: centred values are packed by (chunk of time, block of series), and only packs are paired.

    A task multiplies two packs of one chunk and gives the six sums of each pair of series over their common ticks; the sums are
    added over the chunks. Ticks of a series are unique; a pack holds ticks x series of its chunk and block.
    """
    finite_rows = df.where(finite(F.col("value")))
    centre = F.avg("value").over(W.partitionBy(key))
    placed = finite_rows.select(F.col(key).cast("string").alias("s"), "t_ms", (F.col("value") - centre).alias("v"), F.floor(F.col("t_ms") / chunk_ms).alias("chunk"), F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("block"))
    packs = placed.groupBy("chunk", "block").agg(F.collect_list(F.struct("s", "t_ms", "v")).alias("rows"))
    left, right = packs.select("chunk", F.col("block").alias("i"), F.col("rows").alias("x")), packs.select("chunk", F.col("block").alias("j"), F.col("rows").alias("y"))
    pairs = left.join(right, "chunk").where("i <= j").select("x", "y")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = (pd.DataFrame.from_records([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in rows], columns=["s", "t", "v"]).pivot(index="t", columns="s", values="v") for rows in (x, y))
                ticks = x.index.intersection(y.index)
                a, b = (m.loc[ticks].to_numpy() for m in (x, y))
                here, there = (~np.isnan(m) for m in (a, b))
                a, b = np.nan_to_num(a), np.nan_to_num(b)
                p, q = here.astype(float), there.astype(float)
                sums = [p.T @ q, a.T @ q, p.T @ b, (a * a).T @ q, p.T @ (b * b), a.T @ b]
                first, second = np.meshgrid(x.columns.to_numpy(), y.columns.to_numpy(), indexing="ij")
                out = pd.DataFrame({"a": first.ravel(), "b": second.ravel()} | {c: m.ravel() for c, m in zip(("n", "x", "y", "xx", "yy", "xy"), sums, strict=True)})
                swap = out["a"] > out["b"]
                out.loc[swap, ["a", "b", "x", "y", "xx", "yy"]] = out.loc[swap, ["b", "a", "y", "x", "yy", "xx"]].to_numpy()
                yield out[(out["a"] != out["b"]) & (out["n"] > 0)].drop_duplicates(["a", "b"])

    each = pairs.mapInPandas(products, "a string, b string, n double, x double, y double, xx double, yy double, xy double")
    total = each.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    flat = (vx <= F.col("xx") * 1e-12) | (vy <= F.col("yy") * 1e-12)
    corr = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(vx * vy)))
    own = finite_rows.select(F.col(key).cast("string").alias("a")).distinct()
    return total.select("a", "b", corr.alias("corr")).unionByName(own.select("a", F.col("a").alias("b"), F.lit(1.0).alias("corr")))
