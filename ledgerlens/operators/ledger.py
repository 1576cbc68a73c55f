"""The transaction ledger as window aggregates: positions, cash, violations, snapshots.

Transactions: portfolio_id, t_ms, type, ticker, quantity, price, fee, currency, id. Order within a
portfolio is (t_ms, type priority, id). Every row is applied as written, except in ``strict``, where refused rows change nothing;
``violations`` lists them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Order of transactions at one instant.
PRIORITY = {"Deposit": 0, "Dividend": 1, "Buy": 2, "Sell": 2, "Withdrawal": 3, "Split": 4}


#: Cash is summed as decimals: the result depends on no order and no rounding piles up.
MONEY = "decimal(28,4)"


def priority(kind: Column) -> Column:
    out = F.lit(5)
    for name, n in PRIORITY.items():
        out = F.when(kind == name, F.lit(n)).otherwise(out)
    return out


def _pieces(key: list[str], ends: DataFrame, **before) -> DataFrame:
    """What each piece of time of a key begins with: expressions over the ends of the pieces before it."""
    return ends.select(*key, "_p", *[c.alias(n) for n, c in before.items()])


def positions(txns: DataFrame, piece_ms: int | None = None) -> DataFrame:
    """Asset transactions with ``held`` (before) and ``position`` (after) of the asset.

    With R the running product of split ratios, a position is R times the running sum of quantities by R. With
    ``piece_ms`` the history of an asset is cut into pieces of time that are summed apart: a piece with product r and sum u turns
    the position S that it begins with into r (S + u), so only the ends of the pieces are put in order together.
    """
    q = F.when(F.col("type") == "Buy", F.col("quantity")).when(F.col("type") == "Sell", -F.col("quantity")).otherwise(0.0)
    ratio = F.when(F.col("type") == "Split", F.col("quantity")).otherwise(1.0)
    key = ["portfolio_id", "ticker"]
    assets = txns.where(~F.col("type").isin("Deposit", "Withdrawal"))
    if piece_ms is None:
        step = W.partitionBy(*key).orderBy("t_ms", priority(F.col("type")), "id")
        w = step.rowsBetween(W.unboundedPreceding, 0)
        out = assets.withColumn("_r", F.product(ratio).over(w)).withColumn("_u", F.sum(q / F.col("_r")).over(w)).withColumn("position", F.col("_r") * F.col("_u"))
        return out.withColumn("held", F.coalesce(F.lag("position").over(step), F.lit(0.0))).drop("_r", "_u")
    key = ["portfolio_id", "_k"]
    cut = assets.withColumns({"_k": F.coalesce("ticker", F.lit("")), "_p": F.floor(F.col("t_ms") / piece_ms)})
    step = W.partitionBy(*key, "_p").orderBy("t_ms", priority(F.col("type")), "id")
    w = step.rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_r", F.product(ratio).over(w)).withColumn("_u", F.sum(q / F.col("_r")).over(w))
    ends = local.groupBy(*key, "_p").agg(F.max_by(F.struct("_r", "_u"), F.struct("t_ms", priority(F.col("type")), "id")).alias("e"))
    order = W.partitionBy(*key).orderBy("_p")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    # R at the start of each piece, and the sum by R of all pieces before it.
    scaled = ends.withColumn("_r0", F.coalesce(F.product("e._r").over(earlier), F.lit(1.0)))
    starts = _pieces(key, scaled.withColumn("_u0", F.coalesce(F.sum(F.col("e._u") / F.col("_r0")).over(earlier), F.lit(0.0))), _s=F.col("_r0") * F.col("_u0"))
    before = local.withColumns({"_lr": F.lag("_r", 1, 1.0).over(step), "_lu": F.lag("_u", 1, 0.0).over(step)})
    return before.join(starts, [*key, "_p"]).withColumns({"position": F.col("_r") * (F.col("_s") + F.col("_u")), "held": F.col("_lr") * (F.col("_s") + F.col("_lu"))}).select(*txns.columns, "position", "held")


#: Optional columns: a purchase may be paid in another currency, by a price of its own that counts as it is.
PAYMENT = ("used_currency", "payment_price")


def _elsewhere(txns: DataFrame) -> Column:
    """Whether a row is a purchase that is paid in another currency."""
    return (F.col("type") == "Buy") & F.col("used_currency").isNotNull() if set(PAYMENT) <= set(txns.columns) else F.lit(False)


def purse(txns: DataFrame) -> Column:
    """The currency whose cash a transaction moves."""
    return F.when(_elsewhere(txns), F.col("used_currency")).otherwise(F.col("currency")) if set(PAYMENT) <= set(txns.columns) else F.col("currency")


def asset_delta(txns: DataFrame) -> Column:
    """What an asset transaction with its position does to the cash of its purse."""
    amount = F.col("quantity") * F.col("price")
    own = F.when(_elsewhere(txns), -F.col("payment_price")) if set(PAYMENT) <= set(txns.columns) else F.when(F.lit(False), F.lit(0.0))
    return own.when(F.col("type") == "Buy", -(amount + F.col("fee"))).when(F.col("type") == "Sell", amount - F.col("fee")).when((F.col("type") == "Dividend") & (F.col("held") != 0), F.col("held") * F.col("price") - F.col("fee")).otherwise(0.0)


def cash_delta() -> Column:
    """What a deposit or withdrawal does to the cash of its currency."""
    return F.when(F.col("type") == "Deposit", F.col("quantity") - F.col("fee")).otherwise(-(F.col("quantity") + F.col("fee")))


def cash_deltas(txns: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Every transaction with its effect on the cash of its currency."""
    assets = positions(txns) if assets is None else assets
    keep = ["portfolio_id", "t_ms", "type", "id"]
    money = txns.where(F.col("type").isin("Deposit", "Withdrawal")).select(*keep, "currency", cash_delta().alias("delta"))
    return assets.select(*keep, purse(assets).alias("currency"), asset_delta(assets).alias("delta")).unionByName(money)


def cash(txns: DataFrame, piece_ms: int | None = None) -> DataFrame:
    """Running cash of each portfolio and currency; with ``piece_ms``, summed by pieces of time and the pieces' totals."""
    key = ["portfolio_id", "currency"]
    deltas, amount = cash_deltas(txns), F.col("delta").cast(MONEY)
    order = ["t_ms", priority(F.col("type")), "id"]
    if piece_ms is None:
        w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return deltas.withColumn("balance", F.sum(amount).over(w).cast("double"))
    cut = deltas.withColumn("_p", F.floor(F.col("t_ms") / piece_ms))
    earlier = W.partitionBy(*key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = _pieces(key, cut.groupBy(*key, "_p").agg(F.sum(amount).alias("n")), _s=F.coalesce(F.sum("n").over(earlier), F.lit(0).cast(MONEY)))
    w = W.partitionBy(*key, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_own", F.sum(amount).over(w))
    return local.join(starts, [*key, "_p"]).withColumn("balance", (F.col("_s") + F.col("_own")).cast("double")).drop("_s", "_own", "_p")


def ordered(txns: DataFrame, piece_ms: int) -> DataFrame:
    """Transactions with their ``place`` in their portfolio, counted by pieces of time."""
    cut = txns.withColumn("_p", F.floor(F.col("t_ms") / piece_ms))
    earlier = W.partitionBy("portfolio_id").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = _pieces(["portfolio_id"], cut.groupBy("portfolio_id", "_p").agg(F.count("*").alias("n")), _s=F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    own = F.row_number().over(W.partitionBy("portfolio_id", "_p").orderBy("t_ms", priority(F.col("type")), "id"))
    return cut.withColumn("_own", own).join(starts, ["portfolio_id", "_p"]).withColumn("place", (F.col("_s") + F.col("_own")).cast("long")).drop("_s", "_own", "_p")


def strict(txns: DataFrame, arrival: str | None = None) -> DataFrame:
    """Transactions as a strict ledger takes them: ``held`` before each, ``position`` after it, and the ``reason`` if it is refused.

    A refused row changes nothing, so each verdict hangs on those before it: rows are folded in order within an asset of a
    portfolio, or in order of ``arrival`` within a portfolio, where a row older than the last one taken is refused too. Tasks stream
    their sorted rows in Arrow batches and keep the state of one key only (quantities by asset); a key may be of any length.
    A sale needs the quantity; a dividend or split needs an asset that was ever bought, sold out or not; amounts are not negative.
    """
    key = ["portfolio_id"] if arrival else ["portfolio_id", "_k"]
    rows = txns.withColumn("_k", F.coalesce("ticker", F.concat(F.lit("CASH:"), F.coalesce("currency", F.lit("")))))
    order = [F.col(arrival)] if arrival else [F.col("t_ms"), priority(F.col("type")), F.col("id")]
    rows = rows.repartition(*key).sortWithinPartitions(*key, *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last = None, {}, None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            column = lambda name: batch.column(name).to_pylist()  # noqa: B023, E731
            for *mine, kind, ticker, quantity, t in zip(*map(column, key), column("type"), column("ticker"), column("quantity"), column("t_ms"), strict=True):
                if mine != now:
                    now, held, last = mine, {}, None
                had, quantity, reason = held.get(ticker), quantity or 0.0, None
                if arrival and last is not None and t < last:
                    reason = "out of order"
                elif kind == "Buy":
                    held[ticker] = (had or 0.0) + quantity
                elif kind == "Sell":
                    if had is None or had < quantity:
                        reason = "oversell"
                    else:
                        held[ticker] = had - quantity
                elif kind in ("Dividend", "Split"):
                    if had is None:
                        reason = "no position"
                    elif kind == "Split":
                        held[ticker] = had * quantity
                elif kind in ("Deposit", "Withdrawal"):
                    reason = "negative amount" if quantity < 0 else None
                else:
                    reason = "unknown type"
                if reason is None:
                    last = t
                for values, x in zip(out, (had or 0.0, held.get(ticker, 0.0), reason), strict=True):
                    values.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out[:2], (pa.float64(),) * 2), pa.array(out[2], pa.string())], names=[*batch.schema.names, "held", "position", "reason"])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL("held double, position double, reason string").fields])
    return rows.mapInArrow(fold, schema).drop("_k")


def violations(txns: DataFrame, arrival: str | None = None) -> DataFrame:
    """Transactions that a strict ledger refuses, with the reason."""
    return strict(txns, arrival).where("reason IS NOT NULL").select("portfolio_id", "id", "reason")


def holdings(txns: DataFrame) -> DataFrame:
    """(portfolio_id, asset, t_ms, quantity): the last state of each asset and currency at each instant it changes.

    At one instant dividends come before trades, and trades before splits. So the rows of an instant are summed before any are put in
    order: trades of an asset, the product of its splits, and cash by purse. A dividend pays by what was held before its instant;
    equal ones are counted, so that each is rounded by itself.
    """
    kind = F.col("type")
    money, paid = kind.isin("Deposit", "Withdrawal"), kind == "Dividend"
    fixed = F.when(money, cash_delta()).otherwise(asset_delta(txns)).cast(MONEY)
    rows = txns.where(kind.isNotNull()).withColumn("held", F.lit(0.0)).select(
        "portfolio_id", (~money).alias("_asset"), F.when(~money, F.col("ticker")).alias("ticker"), "t_ms", purse(txns).alias("_purse"), paid.alias("_paid"), F.when(paid, F.col("price")).alias("_price"), F.when(paid, F.col("fee")).alias("_fee"),
        F.when(kind == "Buy", F.col("quantity")).when(kind == "Sell", -F.col("quantity")).otherwise(0.0).alias("_q"), F.when(kind == "Split", F.col("quantity")).otherwise(1.0).alias("_r"), fixed.alias("_d"),
    )
    sums = rows.groupBy("portfolio_id", "_asset", "ticker", "t_ms", "_purse", "_paid", "_price", "_fee").agg(F.sum("_q").alias("_q"), F.product("_r").alias("_r"), F.sum("_d").alias("_d"), F.count("*").alias("_n"))
    w = W.partitionBy("portfolio_id", "_asset", "ticker").orderBy("t_ms")
    before, now = w.rangeBetween(W.unboundedPreceding, -1), w.rangeBetween(W.unboundedPreceding, W.currentRow)
    product, total = F.product("_r"), F.sum("_u")
    scaled = sums.withColumn("_u", F.col("_q") / F.coalesce(product.over(before), F.lit(1.0)))
    a = scaled.withColumns({"position": product.over(now) * total.over(now), "held": F.coalesce(product.over(before) * total.over(before), F.lit(0.0))})
    each = F.when(F.col("held") != 0, F.col("held") * F.col("_price") - F.col("_fee")).otherwise(0.0).cast(MONEY)
    delta = F.col("_d") + F.when(F.col("_paid"), each * F.col("_n").cast("decimal(10,0)")).otherwise(F.lit(0).cast(MONEY))
    none = F.lit(None)
    pair = F.array(F.struct(F.col("ticker").alias("asset"), F.col("position").alias("p"), none.cast("decimal(38,4)").alias("d")), F.struct(F.concat(F.lit("CASH:"), "_purse").alias("asset"), none.cast("double").alias("p"), delta.cast("decimal(38,4)").alias("d")))
    moves = a.select("portfolio_id", "t_ms", F.explode(pair).alias("x")).select("portfolio_id", "t_ms", "x.*").where("asset IS NOT NULL")
    held = moves.groupBy("portfolio_id", "asset", "t_ms").agg(F.max("p").alias("p"), F.sum("d").alias("d"))
    w = W.partitionBy("portfolio_id", "asset").orderBy("t_ms").rowsBetween(W.unboundedPreceding, 0)
    return held.select("portfolio_id", "asset", "t_ms", F.coalesce("p", F.sum("d").over(w).cast("double")).alias("quantity"))


def snapshot_at(txns: DataFrame, until: int | None = None) -> DataFrame:
    """(portfolio_id, asset, quantity) after the last transaction, or the last one at or before ``until``."""
    held = holdings(txns)
    held = held if until is None else held.where(F.col("t_ms") <= until)
    return held.groupBy("portfolio_id", "asset").agg(F.max_by("quantity", "t_ms").alias("quantity"))


def seeds(snapshot: DataFrame, at: int) -> DataFrame:
    """The transactions that bring an empty ledger to a snapshot at once: what came before need not be replayed."""
    cash = F.col("asset").startswith("CASH:")
    zero = F.lit(0.0)
    return snapshot.select(
        "portfolio_id", F.lit(at).cast("long").alias("t_ms"), F.when(cash, F.lit("Deposit")).otherwise(F.lit("Buy")).alias("type"), F.when(~cash, F.col("asset")).alias("ticker"), "quantity",
        zero.alias("price"), zero.alias("fee"), F.when(cash, F.substring("asset", 6, 99)).alias("currency"), F.concat(F.lit("seed-"), "asset").alias("id"),
    )


def append_dedupe(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with those new rows whose id it lacks."""
    return log.unionByName(new.join(log.select("id"), "id", "left_anti").dropDuplicates(["id"]))


def replace_from(old: DataFrame, start: int, new: DataFrame) -> DataFrame:
    """Snapshots before ``start`` and the rebuilt ones."""
    return old.where(F.col("t_ms") < start).unionByName(new)


def build(txns: DataFrame, positions: DataFrame | None = None, cash: DataFrame | None = None) -> DataFrame:
    """(portfolio_id, asset, quantity) of portfolios that open with positions (portfolio_id, asset, quantity) and cash (portfolio_id, currency, amount).

    Amounts of one currency add up, as initial capital does; two opening positions of one asset are an error.
    """
    opening = []
    if positions is not None:
        if not positions.groupBy("portfolio_id", "asset").count().where("count > 1").isEmpty():
            raise ValueError("two or more opening positions of the same asset")
        opening.append(positions.select("portfolio_id", "asset", "quantity"))
    if cash is not None:
        opening.append(cash.groupBy("portfolio_id", F.concat(F.lit("CASH:"), "currency").alias("asset")).agg(F.sum("amount").alias("quantity")))
    log = txns
    for part in opening:
        log = log.unionByName(seeds(part, -(2**62)), allowMissingColumns=True)
    return snapshot_at(log)
