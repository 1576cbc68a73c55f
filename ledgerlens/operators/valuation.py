"""Valuation: holdings and prices expanded onto a regular grid, then one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def on_grid(states: DataFrame, span: tuple[int, int, int], keys: list[str], value: str, before: float | None = 0.0) -> DataFrame:
    """States (keys, t_ms, value) at each tick of the grid (begin, end, step), for every key.

    A state holds from its instant to the next one of its key, so it gives the ticks in between: one window by key, no
    join, and no row for a state that holds at no tick. Before the first state a key has ``before``, or with None that state.
    """
    begin, end, step = span
    w = W.partitionBy(*keys).orderBy("t_ms")
    tick = lambda t: F.greatest(F.ceil((t - begin) / step), F.lit(0)).cast("long")
    last = F.lit((end - begin) // step)
    till = F.when(F.lead("t_ms").over(w).isNull(), last).otherwise(F.least(tick(F.lead("t_ms").over(w)) - 1, last))
    known = states.select(*keys, value, tick(F.col("t_ms")).alias("_own"), till.alias("_till"), F.lag("t_ms").over(w).isNull().alias("_first"))
    spans = known.withColumn("_from", F.when(F.col("_first"), F.lit(0).cast("long")).otherwise(F.col("_own"))).where("_from <= _till")
    out = spans.withColumn("_k", F.explode(F.sequence("_from", "_till")))
    held = F.col(value) if before is None else F.when(F.col("_k") < F.col("_own"), F.lit(float(before))).otherwise(F.col(value))
    return out.select(*keys, (F.col("_k") * step + begin).alias("t_ms"), held.alias(value))


def value_weights(holdings: DataFrame, prices: DataFrame, fx: DataFrame, denomination: DataFrame, span: tuple[int, int, int]) -> DataFrame:
    """(portfolio_id, t_ms, asset, quantity, value, total, weight) at every tick, all in the base currency.

    prices: series_id, t_ms, value; fx: series_id (a currency), t_ms, rate to base as value; denomination: asset, currency.
    The base currency has no fx series and counts 1, as does cash for a price. Totals are summed as decimals, so
    they depend on no order.
    """
    q = on_grid(holdings, span, ["portfolio_id", "asset"], "quantity")
    price = on_grid(prices, span, ["series_id"], "value", None).select(F.col("series_id").alias("asset"), "t_ms", F.col("value").alias("price"))
    rate = on_grid(fx, span, ["series_id"], "value", None).select(F.col("series_id").alias("currency"), "t_ms", F.col("value").alias("rate"))
    ccy = F.when(F.col("asset").startswith("CASH:"), F.substring("asset", 6, 3)).otherwise(F.col("denomination"))
    joined = q.join(denomination.select("asset", F.col("currency").alias("denomination")), "asset", "left").withColumn("currency", ccy).join(price, ["asset", "t_ms"], "left").join(rate, ["currency", "t_ms"], "left")
    value = F.col("quantity") * F.coalesce("price", F.lit(1.0)) * F.coalesce("rate", F.lit(1.0))
    return _weighted(joined.select("portfolio_id", "t_ms", "asset", "quantity", value.alias("value")), "portfolio_id", "t_ms")


def value_at(holdings: DataFrame, prices: DataFrame, fx: DataFrame, denomination: DataFrame, at: int) -> DataFrame:
    """(portfolio_id, asset, quantity, value, total, weight) at one instant, as ``value_weights`` has them at a tick of a grid.

    The newest state of each key up to the instant is one aggregate, so no state is spread over a grid.
    """
    known = F.when(F.col("t_ms") <= at, F.col("t_ms"))
    newest = lambda name: F.coalesce(F.max_by("value", known), F.min_by("value", "t_ms")).alias(name)
    q = holdings.groupBy("portfolio_id", "asset").agg(F.coalesce(F.max_by("quantity", known), F.lit(0.0)).alias("quantity"))
    price = prices.groupBy(F.col("series_id").alias("asset")).agg(newest("price"))
    rate = fx.groupBy(F.col("series_id").alias("currency")).agg(newest("rate"))
    ccy = F.when(F.col("asset").startswith("CASH:"), F.substring("asset", 6, 3)).otherwise(F.col("denomination"))
    joined = q.join(denomination.select("asset", F.col("currency").alias("denomination")), "asset", "left").withColumn("currency", ccy).join(price, "asset", "left").join(rate, "currency", "left")
    value = F.col("quantity") * F.coalesce("price", F.lit(1.0)) * F.coalesce("rate", F.lit(1.0))
    return _weighted(joined.select("portfolio_id", "asset", "quantity", value.alias("value")), "portfolio_id")


def _weighted(values: DataFrame, *keys: str) -> DataFrame:
    """Add the total by key, summed as decimals, and the weight of each value in it."""
    total = F.sum(F.col("value").cast("decimal(28,4)")).over(W.partitionBy(*keys)).cast("double")
    out = values.withColumn("total", total)
    return out.withColumn("weight", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("value") / F.col("total")))


def override(nav: DataFrame, supplied: DataFrame) -> DataFrame:
    """NAV series (portfolio_id, t_ms, nav) in which a supplied series, where there is one, takes the place of the computed one."""
    kept = nav.join(supplied.select("portfolio_id").distinct(), "portfolio_id", "left_anti")
    return kept.select("portfolio_id", "t_ms", "nav").unionByName(supplied.select("portfolio_id", "t_ms", "nav"))


def nav(prices: DataFrame, weights: DataFrame, quantity_based: bool = False) -> DataFrame:
    """(portfolio_id, t_ms, nav) from weights on prices by their first, or from quantities on prices."""
    first = F.first("value").over(W.partitionBy("series_id").orderBy("t_ms"))
    p = prices.withColumn("p0", first)
    total = F.sum("weight").over(W.partitionBy("portfolio_id"))
    w = weights.withColumn("w", F.when(total > 1e-12, F.col("weight") / total).otherwise(F.col("weight")))
    x = F.col("weight") * F.col("value") if quantity_based else F.col("w") * F.col("value") / F.col("p0")
    return w.join(p, "series_id").groupBy("portfolio_id", "t_ms").agg(F.sum(x).alias("nav"))
