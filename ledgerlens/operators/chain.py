"""Snapshot chains: the whole state of a portfolio at each instant of its log, and their renewal from a change on.

A snapshot is one row (portfolio_id, t_ms, positions, cash), with a state for every asset and currency that the
portfolio has ever held by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ledger

P = "portfolio_id"
SNAPSHOT = "portfolio_id bigint, t_ms bigint, positions array<struct<asset:string,quantity:double>>, cash array<struct<currency:string,amount:double>>"


def chain(txns: DataFrame) -> DataFrame:
    """A snapshot at each instant of a log: a state gives the instants until the next one of its asset, so nothing is joined."""
    held = ledger.holdings(txns).withColumn("k", F.dense_rank().over(W.partitionBy(P).orderBy("t_ms")))
    until = F.coalesce(F.lead("k").over(W.partitionBy(P, "asset").orderBy("k")) - 1, F.max("k").over(W.partitionBy(P)))
    spread = held.withColumn("_till", until).select(P, "asset", "quantity", F.col("k").alias("_own"), F.when(F.col("k") <= F.col("_till"), F.col("t_ms")).alias("_t"), F.explode(F.sequence("k", "_till")).alias("k"))
    money = F.col("asset").startswith("CASH:")
    nested = spread.groupBy(P, "k").agg(
        F.max(F.when(F.col("_own") == F.col("k"), F.col("_t"))).alias("t_ms"),
        F.array_sort(F.collect_list(F.when(~money, F.struct("asset", "quantity")))).alias("positions"),
        F.array_sort(F.collect_list(F.when(money, F.struct(F.substring("asset", 6, 99).alias("currency"), F.col("quantity").alias("amount"))))).alias("cash"),
    )
    return nested.select(P, "t_ms", "positions", "cash")


def boundaries(changes: DataFrame) -> DataFrame:
    """(portfolio_id, since): the earliest change of each portfolio."""
    return changes.groupBy(P).agg(F.min("t_ms").alias("since"))


def bases(snapshots: DataFrame, since: DataFrame) -> DataFrame:
    """The last snapshot of each changed portfolio strictly before its change, if any: the state from which to replay.

    Their times are found from two columns; only the rows that are then named are read whole.
    """
    times = snapshots.select(P, "t_ms").join(since, P).where("t_ms < since").groupBy(P).agg(F.max("t_ms").alias("t_ms"))
    return snapshots.join(times, [P, "t_ms"], "left_semi")


def seeds(base: DataFrame) -> DataFrame:
    """The transactions that bring an empty portfolio to a snapshot at the snapshot's own time."""
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    row = lambda kind, items, ticker, currency, amount: base.select(P, "t_ms", F.explode(items).alias("x")).select(
        P, "t_ms", F.lit(kind).alias("type"), ticker.alias("ticker"), amount.alias("quantity"), zero.alias("price"), zero.alias("fee"), currency.alias("currency"), F.concat(F.lit("seed-"), F.coalesce(ticker, currency)).alias("id"),
    )
    return row("Buy", "positions", F.col("x.asset"), none, F.col("x.quantity")).unionByName(row("Deposit", "cash", none, F.col("x.currency"), F.col("x.amount")))


def renewed(log_after: DataFrame, base: DataFrame, since: DataFrame) -> DataFrame:
    """New snapshots from each portfolio's change on: its base and the log after that base, replayed."""
    return chain(seeds(base).unionByName(log_after)).join(since, P).where("t_ms >= since").drop("since")


def summary(snapshots: DataFrame) -> DataFrame:
    """Counts and sums of each snapshot."""
    total = lambda c, field: F.aggregate(c, F.lit(0).cast("decimal(28,4)"), lambda s, x: (s + x[field].cast("decimal(28,4)")).cast("decimal(28,4)"))
    return snapshots.select(P, "t_ms", F.size("positions").cast("long").alias("n_positions"), F.size("cash").cast("long").alias("n_cash"), total(F.col("positions"), "quantity").cast("double").alias("shares"), total(F.col("cash"), "amount").cast("double").alias("cash"))
