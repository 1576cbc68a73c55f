"""Autoregressive models of many series at once: Gram sums in one aggregate, small solves in Arrow tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import p_value
from .series import KEY, finite, over


def split(df: DataFrame, train: float = 0.6, valid: float = 0.2, keys: Sequence[str] = KEY) -> DataFrame:
    """Add ``part``: train, valid or test, by place in time; cut-offs are truncated."""
    n, pos = F.count("*").over(W.partitionBy(*keys)), F.row_number().over(over(keys)) - 1
    a, b = F.floor(n * train), F.floor(n * valid)
    return df.withColumn("part", F.when(pos < a, "train").when(pos < a + b, "valid").otherwise("test"))


def lagged(df: DataFrame, q: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Ticks with their q predecessors as x1..xq (x1 the nearest); ticks without all of them go."""
    out = df.where(finite(F.col("value"))).select(*keys, "t_ms", F.col("value").alias("y"), *[F.lag("value", k).over(over(keys)).alias(f"x{k}") for k in range(1, q + 1)])
    return out.where(F.col(f"x{q}").isNotNull())


def fit_ols(df: DataFrame, q: int, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, c, phi, sigma, covariance, std_errors, t, p, stationary, n) by least squares with intercept, for each series.

    Only (q + 2) squared sums a series leave the aggregate; the solves are (q + 1) wide. Series with too few ticks
    or a singular system have null results.
    """
    names = ["1", *[f"x{k}" for k in range(1, q + 1)], "y"]
    term = lambda a: F.lit(1.0) if a == "1" else F.col(a)
    cells = [(i, j) for i in range(q + 2) for j in range(i, q + 2)]
    sums = lagged(df, q, keys).groupBy(*keys).agg(F.array(*[F.sum(term(names[i]) * term(names[j])) for i, j in cells]).alias("g"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for g in pdf["g"]:
                m = np.zeros((q + 2, q + 2))
                for (i, j), v in zip(cells, g, strict=True):
                    m[i, j] = m[j, i] = v
                n, a, b, yy = m[0, 0], m[: q + 1, : q + 1], m[: q + 1, q + 1], m[q + 1, q + 1]
                if n <= q + 1 or np.linalg.matrix_rank(a) < q + 1:
                    rows.append((None,) * 7 + (int(n),))
                    continue
                inverse = np.linalg.inv(a)
                beta = inverse @ b
                s2 = max(0.0, yy - beta @ b) / (n - q - 1)
                se = np.sqrt(s2 * np.diag(inverse))
                t = [float(x / e) if e > 0 else None for x, e in zip(beta, se, strict=True)]
                companion = np.zeros((q, q))
                companion[0] = beta[1:]
                companion[1:, :-1] = np.eye(q - 1)
                rows.append((float(beta[0]), beta[1:].tolist(), math.sqrt(s2), (s2 * inverse).tolist(), se.tolist(), t, bool((abs(np.linalg.eigvals(companion)) < 1).all()), int(n)))
            out = pd.DataFrame(rows, columns=["c", "phi", "sigma", "covariance", "std_errors", "t", "stationary", "n"])
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), out], axis=1)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema.fields[: len(keys)])
    fitted = sums.mapInPandas(solve, f"{fields}, c double, phi array<double>, sigma double, covariance array<array<double>>, std_errors array<double>, t array<double>, stationary boolean, n long")
    return fitted.withColumn("p", F.transform("t", p_value))


def predict(df: DataFrame, models: DataFrame, q: int, keys: Sequence[str] = KEY) -> DataFrame:
    """One-step predictions at every tick with q predecessors, with the fitted ``sigma`` of the model."""
    x = lagged(df, q, keys).join(models.select(*keys, "c", "phi", "sigma"), list(keys))
    total = F.col("c")
    for k in range(1, q + 1):
        total = total + F.col("phi")[k - 1] * F.col(f"x{k}")
    return x.select(*keys, "t_ms", F.col("y").alias("actual"), total.alias("predicted"), "sigma")


def evaluate(pred: DataFrame, n_params: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Error metrics of (actual, predicted, sigma) rows for each series.

    The likelihood is that of the fitted sigma; rows without one have that of their own root mean squared error.
    """
    if "sigma" not in pred.columns:
        pred = pred.withColumn("sigma", F.lit(None).cast("double"))
    e = F.col("actual") - F.col("predicted")
    sums = pred.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop("actual") * F.count("*")).alias("sst"), F.max("sigma").alias("sigma"))
    mse = F.col("sse") / F.col("n")
    s2 = F.coalesce(F.col("sigma") * F.col("sigma"), mse)
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
    room = F.col("n") - n_params - 1
    ll = F.when(s2 > 0, -F.col("n") / 2 * F.ln(2 * F.pi() * s2) - F.col("sse") / (2 * s2))
    return sums.select(*keys, "n", mse.alias("mse"), F.sqrt(mse).alias("rmse"), "mae", r2.alias("r2"), F.when(room > 0, 1 - (1 - r2) * (F.col("n") - 1) / room).alias("adj_r2"), ll.alias("log_likelihood"), (2 * (n_params + 2) - 2 * ll).alias("aic"))


def forecast(df: DataFrame, models: DataFrame, q: int, steps: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Recursive forecasts at last + k * (last step), k = 1..steps."""
    last = df.where(finite(F.col("value"))).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("t_ms")))).where(F.col("_r") <= max(q, 2))
    window = last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]).alias("w"), F.max("t_ms").alias("t0"), (F.max("t_ms") - F.min(F.when(F.col("_r") == 2, F.col("t_ms")))).alias("dt"))
    joined = window.join(models.select(*keys, "c", "phi"), list(keys)).where("phi IS NOT NULL")
    dot = lambda w: F.aggregate(F.zip_with(F.slice(w, 1, q), F.col("phi"), lambda a, b: a * b), F.col("c"), lambda s, x: s + x)
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("w"), lambda w, k: F.concat(F.array(dot(w)), w))
    out = joined.select(*keys, "t0", "dt", F.posexplode(F.reverse(F.slice(path, 1, steps))).alias("k", "predicted"))
    return out.select(*keys, (F.col("t0") + (F.col("k") + 1) * F.col("dt")).alias("t_ms"), "predicted")


def rolling_error(pred: DataFrame, last_n: int, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, rolling_mse, n): the mean squared error of the last_n newest (actual, predicted) rows of each series."""
    w = W.partitionBy(*keys).orderBy(F.desc("t_ms"))
    newest = pred.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last_n)
    return newest.groupBy(*keys).agg(F.avg((F.col("actual") - F.col("predicted")) ** 2).alias("rolling_mse"), F.count("*").alias("n"))


def refit(df: DataFrame, models: DataFrame, q: int, last_n: int, limit: float, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, c, phi, sigma, rolling_mse, refitted, context): models after the data of ``df``, which include what they were fitted on.

    A model whose error over its last_n newest predictions is above the limit is fitted anew on all data; the others
    stay. Every series carries on its q newest values as context, the newest first. A refit that has no solution keeps the old model.
    """
    errors = rolling_error(predict(df, models, q, keys), last_n, keys).withColumn("due", F.coalesce(F.col("rolling_mse") > limit, F.lit(False)))
    names = list(keys)
    # Only series that are due are fitted.
    again = fit_ols(df.join(errors.where("due").select(*names), names, "left_semi"), q, keys).where("c IS NOT NULL").select(*names, F.struct("c", "phi", "sigma").alias("new"))
    newest = df.where(finite(F.col("value"))).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("t_ms")))).where(F.col("_r") <= q)
    context = newest.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]).alias("context"))
    joined = models.select(*names, F.struct("c", "phi", "sigma").alias("old")).join(errors, names, "left").join(again, names, "left").join(context, names, "left")
    return joined.select(*names, F.coalesce("new", "old").alias("m"), "rolling_mse", F.col("new").isNotNull().alias("refitted"), "context").select(*names, "m.*", "rolling_mse", "refitted", "context")
