"""The strict ledger against a plain fold with chained refusals, and sums by pieces against sums in one."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ledger as L

LOG = "portfolio_id long, t_ms long, type string, ticker string, quantity double, price double, fee double, currency string, id string, seq long"


def log_of(rng, n):
    rows = []
    for k in range(n):
        kind = rng.choice(["Buy", "Sell", "Sell", "Dividend", "Split", "Deposit", "Withdrawal", "Gift"])
        ticker = None if kind in ("Deposit", "Withdrawal") else rng.choice("ABC")
        quantity = rng.choice([0.5, 2.0]) if kind == "Split" else float(rng.randint(-3 if ticker is None else 0, 40))
        rows.append((rng.randint(1, 3), rng.randint(0, 60), kind, ticker, quantity, 1.5, 0.25, rng.choice(["USD", "EUR"]), f"i{k:04}", k))
    return rows


def fold(rows, by_arrival):
    """{id: reason} of the refused rows."""
    rank = lambda r: (r[0], r[9]) if by_arrival else (r[0], r[1], L.PRIORITY.get(r[2], 5), r[8])
    refused, held, last = {}, {}, {}
    for p, t, kind, ticker, q, *_, ident, _ in sorted(rows, key=rank):
        had, why = held.get((p, ticker)), None
        if by_arrival and t < last.get(p, t):
            why = "out of order"
        elif kind == "Buy":
            held[p, ticker] = (had or 0) + q
        elif kind == "Sell":
            why = "oversell" if had is None or had < q else held.update({(p, ticker): had - q})
        elif kind in ("Dividend", "Split"):
            why = "no position" if had is None else (held.update({(p, ticker): had * q}) if kind == "Split" else None)
        elif kind in ("Deposit", "Withdrawal"):
            why = "negative amount" if q < 0 else None
        else:
            why = "unknown type"
        if why:
            refused[ident] = why
        else:
            last[p] = t
    return refused


def test_strict_ledger_with_chained_refusals(spark):
    chained = [(9, 1, "Buy", "A", 10.0, 1.0, 0.0, "USD", "a", 1), (9, 2, "Sell", "A", 11.0, 1.0, 0.0, "USD", "b", 2), (9, 3, "Sell", "A", 10.0, 1.0, 0.0, "USD", "c", 3), (9, 4, "Dividend", "A", 0.0, 1.0, 0.0, "USD", "d", 4), (9, 5, "Split", "B", 2.0, 1.0, 0.0, "USD", "e", 5)]
    rows = log_of(random.Random(4), 400) + chained
    txns = spark.createDataFrame(rows, LOG).repartition(5)
    got = {r["id"]: r["reason"] for r in L.violations(txns).collect()}
    assert got == fold(rows, False) and [got.get(x) for x in "abcde"] == [None, "oversell", None, None, "no position"]
    assert set(got.values()) == {"oversell", "no position", "negative amount", "unknown type"}
    late = {r["id"]: r["reason"] for r in L.violations(txns, "seq").collect()}
    assert late == fold(rows, True) and "out of order" in late.values()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # the state is carried from batch to batch
    try:
        assert {r["id"]: r["reason"] for r in L.violations(txns).collect()} == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert L.violations(txns.where("false")).count() == 0


def test_pieces_give_the_same_rows(spark):
    txns = spark.createDataFrame([r for r in log_of(random.Random(6), 500) if r[2] != "Gift"], LOG)
    near = lambda df, *cols: sorted((r["id"], *(round(r[c], 6) for c in cols)) for r in df.collect())
    for piece in (8, 1, 1000):  # of 60 instants: eight pieces, one each, one
        assert near(L.positions(txns, piece), "held", "position") == near(L.positions(txns), "held", "position")
        assert near(L.cash(txns, piece), "delta", "balance") == near(L.cash(txns), "delta", "balance")
    places = L.ordered(txns, 8).orderBy("portfolio_id", "place").collect()
    assert [r["id"] for r in places] == [r["id"] for r in txns.orderBy("portfolio_id", "t_ms", L.priority(F.col("type")), "id").collect()]
    assert [r["place"] for r in places if r["portfolio_id"] == 1] == list(range(1, 1 + sum(r["portfolio_id"] == 1 for r in places)))


def test_payment_in_another_currency_and_opening_balances(spark):
    rows = [(1, 1, "Deposit", None, 100.0, 0.0, 0.0, "USD", "a", None, None), (1, 2, "Buy", "A", 4.0, 5.0, 1.0, "USD", "b", "EUR", 17.5), (1, 3, "Buy", "A", 1.0, 5.0, 1.0, "USD", "c", None, None)]
    txns = spark.createDataFrame(rows, "portfolio_id long, t_ms long, type string, ticker string, quantity double, price double, fee double, currency string, id string, used_currency string, payment_price double")
    held = lambda df: {r["asset"]: r["quantity"] for r in df.collect()}
    assert held(L.snapshot_at(txns)) == {"A": 5.0, "CASH:USD": 94.0, "CASH:EUR": -17.5}
    assert {(r["id"], r["currency"], r["balance"]) for r in L.cash(txns).collect()} == {("a", "USD", 100.0), ("b", "EUR", -17.5), ("c", "USD", 94.0)}
    positions = spark.createDataFrame([(1, "A", 2.0), (1, "B", 3.0), (2, "A", 1.0)], "portfolio_id long, asset string, quantity double")
    cash = spark.createDataFrame([(1, "USD", 5.0), (1, "USD", 7.0), (1, "JPY", 1.0)], "portfolio_id long, currency string, amount double")
    built = {(r["portfolio_id"], r["asset"]): r["quantity"] for r in L.build(txns, positions, cash).where("asset IS NOT NULL").collect()}
    assert built == {(1, "A"): 7.0, (1, "B"): 3.0, (2, "A"): 1.0, (1, "CASH:USD"): 106.0, (1, "CASH:EUR"): -17.5, (1, "CASH:JPY"): 1.0}
    with pytest.raises(ValueError):
        L.build(txns, positions.unionByName(positions.limit(1)))
