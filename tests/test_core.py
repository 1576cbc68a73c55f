import math
import random
from calendar import monthrange
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens import catalog
from ledgerlens.functions import stats
from ledgerlens.operators import calendar as C
from ledgerlens.operators import ledger as L
from ledgerlens.operators import models as M
from ledgerlens.operators import resample as R
from ledgerlens.operators import series as S
from ledgerlens.operators import valuation as P
from ledgerlens.plans import views as V
from ledgerlens.plans.metrics import Registry
from ledgerlens.sources import files

DAY = 86_400_000


def make(spark, values, times=None, sid="a"):
    times = times or [1000 * (k + 1) for k in range(len(values))]
    return spark.createDataFrame([(sid, t, float(v)) for t, v in zip(times, values, strict=True)], "series_id string, t_ms long, value double")


def values(df, c="value"):
    return [r[c] for r in df.orderBy("t_ms").collect()]


@pytest.fixture(scope="module")
def simple(spark):
    return make(spark, [1, 2, 3, 4, 5])


@pytest.fixture(scope="module")
def decade(spark):
    return make(spark, [10, 20, 30, 40, 50])


def ticks(spark, *t):
    return spark.createDataFrame([("a", x) for x in t], "series_id string, t_ms long")


def test_algebra(simple, decade, spark):
    assert values(S.combine(decade, simple, "add")) == [11, 22, 33, 44, 55]
    assert values(S.combine(decade, simple, "mul")) == [10, 40, 90, 160, 250]
    assert values(S.combine(simple, make(spark, [0] * 5), "div")) == [0] * 5
    assert values(S.shift(decade, 1)) == [10, 20, 30, 40]
    assert S.misaligned(make(spark, [1, 2], [1000, 2000]), make(spark, [1, 2], [1000, 2001])).first()["n_misaligned"] == 2
    with pytest.raises(ZeroDivisionError):
        S.scalar(simple, "div", 0)
    assert [round(x, 6) for x in values(S.returns(S.combine(simple, decade, "add"), "simple"))] == [1.0, 0.5, round(1 / 3, 6), 0.25]


def test_merge_prefers_new(spark):
    old, new = make(spark, [1, 2, 3]), make(spark, [22, 4], [2000, 4000])
    assert values(S.merge(old, new)) == [1, 22, 3, 4] and values(S.merge(old, new.limit(0))) == [1, 2, 3]


def test_resampling(simple, spark):
    assert values(R.resample(simple, ticks(spark, 1500, 2500), "linear")) == [1.5, 2.5]
    assert values(R.resample(simple, ticks(spark, 1300, 1500, 1700), "nearest")) == [1, 2, 2]
    assert values(R.resample(simple, ticks(spark, 500, 2900, 9000), "latest")) == [1, 2, 5]
    assert values(R.resample(simple, ticks(spark, 500, 2000), "latest", strict_lookback=True)) == [None, 2]
    assert values(R.resample(simple, ticks(spark, 2000, 2001), "exact")) == [2, None]
    assert values(R.resample(simple, simple.select("series_id", "t_ms"), "linear")) == [1, 2, 3, 4, 5]


def test_grids_and_steps(spark):
    grid = lambda a, b, f: [r["t_ms"] for r in R.grid_regular(spark.createDataFrame([(a, b)], "begin long, end long"), f).collect()]
    assert grid(0, 10, 5) == [0, 5, 10] and grid(0, 10, 3) == [0, 3, 6, 9] and grid(5, 5, 1) == [5] and grid(0, 10, 100) == [0]
    points = spark.createDataFrame([("a", 250, 9.0, 0), ("a", 150, 1.0, 1), ("a", 150, 5.0, 2)], "series_id string, t_ms long, value double, seq int")
    assert values(R.step_series(points, ticks(spark, 100, 150, 200, 250))) == [0, 5, 5, 9]
    assert R.regularity(make(spark, range(9))).first()["regular"] and not R.regularity(make(spark, [1, 2, 3, 4], [0, 1000, 2500, 4500])).first()["regular"]


def test_noise_does_not_depend_on_partitions(spark):
    s = make(spark, [0, 1, 4, 9])
    g = ticks(spark, *range(1000, 4001, 100))
    a, b = (values(R.stochastic(s.repartition(n), g.repartition(n), 1e-3)) for n in (1, 8))
    assert a == b and a[0] == 0 and a[-1] == 9 and a[5] != 0.5


def test_statistics(simple, spark):
    r = simple.groupBy("series_id").agg(stats.mean("value").alias("m"), stats.variance("value").alias("s"), stats.variance("value", False).alias("p"), stats.quantile("value", 0.25).alias("q"), stats.kurtosis("value").alias("k"), stats.cdf("value", 2).alias("c")).first()
    assert (r["m"], r["s"], r["p"], r["q"], r["c"]) == (3, 2.5, 2, 2, 0.4) and abs(r["k"] - 1.7) < 1e-9
    flat = make(spark, [5, 5, 5]).groupBy("series_id").agg(stats.skew("value").alias("s"), stats.kurtosis("value").alias("k"), stats.sharpe("value").alias("h")).first()
    assert (flat["s"], flat["k"], flat["h"]) == (0, 0, 0)
    larger = make(spark, [10 * math.sin(0.1 * k) for k in range(100)])
    acf = [r["acf"] for r in stats.acf(larger, 5).orderBy("lag").collect()]
    assert acf[0] == 1 and all(abs(x) <= 1 for x in acf)
    t = {(r["i"], r["j"]): r["value"] for r in stats.toeplitz(larger, 5).collect()}
    assert len(t) == 25 and all(t[i, j] == t[j, i] for i, j in t) and len({t[i, i] for i in range(5)}) == 1
    z = values(S.zscores(make(spark, [3, 3, 3])), "z")
    assert z == [0, 0, 0]


def ledger_rows(spark):
    rows = [(1, "Deposit", None, 10000, 0, 0), (2, "Buy", "STCK", 100, 10, 5), (3, "Dividend", "STCK", 0, 0.1, 0), (4, "Sell", "STCK", 50, 10, 5), (5, "Withdrawal", None, 500, 0, 0), (6, "Split", "STCK", 2, 0, 0)]
    return spark.createDataFrame([(1, t * DAY, k, s, float(q), float(p), float(f), "EUR", f"x{t}") for t, k, s, q, p, f in rows], "portfolio_id int, t_ms long, type string, ticker string, quantity double, price double, fee double, currency string, id string")


def test_ledger_golden(spark):
    t = ledger_rows(spark)
    assert values(L.positions(t), "position") == [100, 100, 50, 100]
    assert [round(x, 6) for x in values(L.cash(t).where("delta <> 0"), "balance")] == [10000, 8995, 9005, 9500, 9000]
    assert L.violations(t).count() == 0
    bad = t.withColumn("quantity", F.when(F.col("type") == "Sell", 500.0).otherwise(F.col("quantity")))
    assert [r["reason"] for r in L.violations(bad).collect()] == ["oversell"]
    prices = make(spark, [10, 5], [0, 6 * DAY], "STCK")
    empty = spark.createDataFrame([], "series_id string, t_ms long, value double")
    den = spark.createDataFrame([("STCK", "EUR")], "asset string, currency string")
    out = P.value_weights(L.holdings(t), prices, empty, den, (0, 8 * DAY, DAY))
    totals = [r["v"] for r in out.groupBy("t_ms").agg(F.round(F.sum("value"), 6).alias("v")).orderBy("t_ms").collect()]
    assert totals == [0, 10000, 9995, 10005, 10000, 9500, 9500, 9500, 9500]
    assert L.append_dedupe(t, t).count() == t.count()


def test_models(spark):
    y = [10.0, 10.0]
    for i in range(2, 500):
        y.append(1 + 0.5 * y[-1] + 0.3 * y[-2] + 0.01 * math.sin(i))
    m = M.fit_ols(make(spark, y), 2).first()
    assert m["stationary"] and abs(sum(m["phi"]) - 0.8) < 0.1
    pred = spark.createDataFrame([("a", k, float(k), k + 0.5) for k in range(1, 5)], "series_id string, t_ms long, actual double, predicted double")
    e = M.evaluate(pred, 1).first()
    assert (e["mse"], e["rmse"], e["mae"]) == (0.25, 0.5, 0.5)
    f = values(M.forecast(make(spark, y), M.fit_ols(make(spark, y), 2), 2, 3), "predicted")
    assert len(f) == 3 and all(abs(x - y[-1]) < 1 for x in f)
    phi = stats.levinson(make(spark, y), 2).first()["phi"]
    assert len(phi) == 2


def test_calendar(spark):
    holidays = spark.createDataFrame([("2024-01-01",)], "day string").select(F.to_date("day").alias("day"))
    days = {str(r["day"]) for r in C.trading_days(spark, "2023-12-29", "2024-01-03", holidays).collect()}
    assert days == {"2023-12-29", "2024-01-02", "2024-01-03"}
    table = C.roll_table(spark, "2023-12-01", "2024-01-31", holidays).where("day = '2023-12-31'")
    assert str(table.select(C.roll("following").alias("x")).first()["x"]) == "2024-01-02"
    assert str(table.select(C.roll("modified_following").alias("x")).first()["x"]) == "2023-12-29"
    rules = spark.createDataFrame([("2024-01-31", "2024-04-30", "month", 1)], "s string, e string, unit string, step int").select(F.to_date("s").alias("start"), F.to_date("e").alias("end"), "unit", "step")
    assert [str(r["day"]) for r in C.recurrence(rules).orderBy("day").collect()] == ["2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30"]


def order_days(spark, tmp_path):
    """Orders on some days from Saturday 1999-12-18 to Friday 2001-08-03, and the trading days that follow from them."""
    rng, first, last = random.Random(3), date(1999, 12, 18), date(2001, 8, 3)
    span = [first + timedelta(k) for k in range((last - first).days + 1)]
    days = [first, last, *(x for x in span if rng.random() < 0.8)]
    orders = [(k, x) for k, x in enumerate(days[:60] + days[-5:], 1)] + [(1000 + k, x) for k, x in enumerate(days)]
    spark.createDataFrame([(k, str(x)) for k, x in orders], "o_orderkey long, o_orderdate string").withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    held = set(days)
    return orders, lambda x: x.weekday() < 5 and (x.month, x.day) != (1, 1) and (not first <= x <= last or x in held)


def rolled(day, is_open):
    """(following, preceding) by walking day by day."""
    f = p = day
    while not is_open(f):
        f += timedelta(1)
    while not is_open(p):
        p -= timedelta(1)
    return f, p


def test_recurrences_of_all_orders(spark, tmp_path):
    orders, is_open = order_days(spark, tmp_path)
    later = lambda x, n: date(x.year + (x.month - 1 + n) // 12, (x.month - 1 + n) % 12 + 1, min(x.day, monthrange(x.year + (x.month - 1 + n) // 12, (x.month - 1 + n) % 12 + 1)[1]))
    raw, roll = set(), set()
    for key, start in orders:
        n, step, k = key % 5, key % 3 + 1, 0
        while (day := start + timedelta(k * step * (1, 7)[n]) if n < 2 else later(start, k * step * (1, 3, 12)[n - 2])) <= later(start, 18):
            f, p = rolled(day, is_open)
            raw.add((key, str(day)))
            roll.add((key, str(f if f.month == day.month else p)))
            k += 1
    run = catalog.queries()
    got = [tuple(r) for r in run["recurrence_raw"](spark, str(tmp_path)).collect()]
    assert len(got) == len(raw) and set(got) == raw and max(d for _, d in raw) > "2003"
    got = [tuple(r) for r in run["recurrence_rolled"](spark, str(tmp_path)).collect()]
    assert len(got) == len(roll) and set(got) == roll


def test_grid_of_all_portfolios(spark):
    d = "/root/testdata/sf0.001"
    held, money, ticks = defaultdict(set), dict(V.denomination(spark, d).collect()), defaultdict(set)
    for r in L.holdings(V.txns(spark, d)).where("quantity <> 0").collect():
        held[r["portfolio_id"]].add(r["asset"])
    for r in [*V.prices(spark, d).collect(), *V.fx(spark, d).collect()]:
        ticks[r["series_id"]].add(r["t_ms"])
    want = {(p, x) for p, assets in held.items() for a in assets for s in (a, money.get(a, a.removeprefix("CASH:"))) if s != "USD" for x in ticks[s]}
    got = [tuple(r) for r in catalog.queries()["portfolio_grid"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want and len({p for p, _ in got}) > 3


def test_rolls_of_all_days(spark, tmp_path):
    orders, is_open = order_days(spark, tmp_path)
    first, last = min(x for _, x in orders), max(x for _, x in orders)
    span = [first + timedelta(k) for k in range((last - first).days + 1)]
    forms = {
        "unadjusted": lambda x, f, p: x, "following": lambda x, f, p: f, "preceding": lambda x, f, p: p,
        "modified_following": lambda x, f, p: f if f.month == x.month else p, "modified_preceding": lambda x, f, p: p if p.month == x.month else f,
    }
    for name, form in forms.items():
        got = {r["day"]: r["rolled"] for r in catalog.queries()[f"roll_{name}"](spark, str(tmp_path)).collect()}
        assert got == {str(x): str(form(x, *rolled(x, is_open))) for x in span}


def test_registry_resolves_chains_and_refuses_cycles(simple):
    r = Registry()
    r.add_series("x2", ["base"], lambda s: S.scalar(s, "mul", 2))
    r.add_series("x4", ["x2"], lambda s: S.scalar(s, "mul", 2))
    assert values(r.resolve("x4", {"base": simple})) == [4, 8, 12, 16, 20]
    r.add_series("a", ["b"], lambda s: s)
    r.add_series("b", ["a"], lambda s: s)
    with pytest.raises(ValueError):
        r.resolve("a", {})


def test_files(spark, tmp_path):
    (tmp_path / "s" / "AAPL").mkdir(parents=True)
    (tmp_path / "s" / "AAPL" / "86400000.csv").write_text("timestamp;value\n1000;1.5\n2000;NaN\n3000;2\n")
    rows = files.read_series(spark, str(tmp_path / "s")).orderBy("t_ms").collect()
    assert [tuple(r) for r in rows] == [("AAPL", 86_400_000, 1000, 1.5), ("AAPL", 86_400_000, 3000, 2.0)]
    files.save_series(files.read_series(spark, str(tmp_path / "s")), str(tmp_path / "p"))
    new = spark.createDataFrame([("AAPL", 86_400_000, 3000, 9.0)], "series_id string, freq_ms long, t_ms long, value double")
    assert files.upsert_series(spark, str(tmp_path / "p"), new).where("value = 9").count() == 1
    with pytest.raises(ValueError):
        files.save_series(new.withColumn("is_synthetic", F.lit(True)), str(tmp_path / "q"))
    head = "Symbol,Trade Date,Purchase Price,Quantity,Commission,Transaction Type,Currency\n"
    (tmp_path / "b.csv").write_text(head + "ABC,20240102,10,5,,BUY,usd\n$$CASH_TX,20240101,,1000,,DEPOSIT,\nABC,2024,1,1,,BUY,\nABC,20240103,1,1,,HOLD,\n")
    got = [(r["type"], r["ticker"], r["quantity"], r["fee"], r["currency"]) for r in files.import_broker(spark, str(tmp_path / "b.csv")).collect()]
    assert got == [("Deposit", None, 1000.0, 0.0, "EUR"), ("Buy", "ABC", 5.0, 0.0, "USD")]
    held = L.holdings(ledger_rows(spark))
    files.write_snapshots(held, str(tmp_path / "snap"))
    order = lambda d: sorted(map(tuple, d.select("portfolio_id", "t_ms", "asset", "quantity").collect()))
    assert order(files.read_snapshots(spark, str(tmp_path / "snap"))) == order(held)


def test_points_across_buckets_and_grid_service(spark):
    """An exact bar of any bucket first, then the last bar of the finest bucket that reaches back far enough."""
    from ledgerlens.operators import buckets as B

    rows = [(1, 1, 10, 1.0), (1, 1, 12, 2.0), (1, 5, 5, 7.0), (1, 5, 15, 8.0), (2, 5, 0, 4.0)]
    stored = spark.createDataFrame(rows, "series_id long, freq_ms long, t_ms long, value double")
    asks = spark.createDataFrame([(1, 15), (1, 13), (1, 9), (1, 1), (2, 3)], "series_id long, t_ms long")
    got = {(r["series_id"], r["t_ms"]): (r["value"], r["error"]) for r in B.points(stored, asks).collect()}
    assert got == {(1, 15): (8.0, None), (1, 13): (2.0, None), (1, 9): (7.0, None), (1, 1): (None, "no data for 1 at 1"), (2, 3): (4.0, None)}
    exact = {(r["series_id"], r["t_ms"]): r["value"] for r in B.points(stored, asks, exact_only=True).collect()}
    assert exact[1, 15] == 8.0 and exact[1, 13] is None and B.points(stored, asks.limit(0)).count() == 0
    grid = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 0)], "series_id long, t_ms long")
    aligned = {(r["series_id"], r["t_ms"]): r["value"] for r in B.on_grid(stored, grid, "exact").collect()}
    assert aligned == {(1, 10): 1.0, (1, 11): None, (1, 12): 2.0, (2, 0): 4.0}
    filled = {(r["series_id"], r["t_ms"]): r["value"] for r in B.on_grid(stored, grid, "latest").collect()}
    assert filled == {(1, 10): None, (1, 11): None, (1, 12): None, (2, 0): 4.0}  # the coarsest covering bucket holds no bar within the grid's range


def test_states_on_a_regular_grid(spark):
    states = spark.createDataFrame([(1, 5, 1.0), (1, 12, 2.0), (1, 13, 3.0), (2, -4, 9.0), (3, 99, 5.0)], "k long, t_ms long, q double")
    want = {(1, 0): 0.0, (1, 10): 1.0, (1, 20): 3.0, (1, 30): 3.0} | {(2, t): 9.0 for t in (0, 10, 20, 30)} | {(3, t): 0.0 for t in (0, 10, 20, 30)}
    assert {(r["k"], r["t_ms"]): r["q"] for r in P.on_grid(states, (0, 35, 10), ["k"], "q").collect()} == want
    first = {(r["k"], r["t_ms"]): r["q"] for r in P.on_grid(states, (0, 35, 10), ["k"], "q", None).collect()}
    assert first[1, 0] == 1.0 and first[3, 30] == 5.0


def test_loading_from_a_snapshot_equals_a_replay(spark):
    t = ledger_rows(spark)
    mid = sorted(r["t_ms"] for r in t.select("t_ms").collect())[t.count() // 2]
    loaded = L.snapshot_at(L.seeds(L.snapshot_at(t, mid), mid).unionByName(t.where(F.col("t_ms") > mid).select("portfolio_id", "t_ms", "type", "ticker", "quantity", "price", "fee", "currency", "id")))
    rows = lambda df: sorted((r["portfolio_id"], r["asset"], round(r["quantity"], 6)) for r in df.collect())
    assert rows(loaded) == rows(L.snapshot_at(t))


def test_segments_by_key(spark):
    """Masks of tiled, overlapping and open segments, against a check of every pair."""
    from ledgerlens.operators import intervals as I

    grid = spark.createDataFrame([(k, t) for k in range(6) for t in (100, 150, 200, 250)], "k long, t_ms long")
    named = [(0, 150, 250), (1, 150, None), (2, 50, 200), (3, 300, None), (4, 20, 50), (5, 50, 200), (5, 200, None)]
    for width in (1, 30, 1000):
        got = I.segment_mask(grid, spark.createDataFrame(named, "k long, begin long, end long"), ["k"], width).collect()
        masks = {k: "".join(str(r["mask"]) for r in sorted(got, key=lambda r: r["t_ms"]) if r["k"] == k) for k in range(6)}
        assert masks == {0: "0110", 1: "0111", 2: "1100", 3: "0000", 4: "0000", 5: "1111"}
    rng = random.Random(3)
    points = [(rng.randint(0, 3), rng.randint(-50, 50)) for _ in range(200)]
    spans = [(rng.randint(0, 4), a := rng.randint(-80, 60), rng.choice([None, a, a + rng.randint(0, 60)])) for _ in range(60)]
    got = I.segment_mask(spark.createDataFrame(points, "k long, t_ms long"), spark.createDataFrame(spans, "k long, begin long, end long"), ["k"], 7).collect()
    want = sorted((k, t, sum(s == k and a <= t and (b is None or t < b) for s, a, b in spans)) for k, t in points)
    assert sorted((r["k"], r["t_ms"], r["n_segments"]) for r in got) == want and all(r["mask"] == (r["n_segments"] > 0) for r in got)


def test_segment_masks_send_no_side_to_the_driver(spark):
    """A grid exploded from few rows looks small to the planner; null keys and times lie in no segment."""
    from ledgerlens.operators import intervals as I

    grid = spark.range(40).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(900), F.lit(30)).cast("array<long>")).alias("t_ms"))
    spans = spark.createDataFrame([(k, 15 * k, 15 * k + 100 if k % 3 else None) for k in range(40)] + [(None, 0, None), (1, None, 50), (2, 90, 60)], "k long, begin long, end long")
    got = I.segment_mask(grid, spans, ["k"], 70)
    assert {(r["k"], r["t_ms"]): r["n_segments"] for r in got.collect()} == {(k, t): int(15 * k <= t and (k % 3 == 0 or t < 15 * k + 100)) for k in range(40) for t in range(0, 901, 30)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    odd = I.segment_mask(spark.createDataFrame([(None, 5), (3, None), (3, 400), (3, 400)], "k long, t_ms long"), spans, ["k"], 70)
    assert sorted(tuple(r) for r in odd.collect() if r["k"] and r["t_ms"]) == [(3, 400, 1, 1)] * 2 and odd.where("k IS NULL OR t_ms IS NULL").where("mask = 0 AND n_segments = 0").count() == 2


def test_a_shared_rule_is_expanded_once_and_repeated_orders_count_once(spark, tmp_path, monkeypatch):
    import duckdb

    # Keys that are equal modulo 15 have one rule a start; keys 2 and 15 come twice, with one start and with two.
    days = ["2000-01-14", "2000-01-15", "2000-02-28"]
    orders = [(k, days[k % 2]) for k in range(60)] + [(2, days[0]), (15, days[2]), (None, days[0]), (70, None)]
    spark.createDataFrame(orders, "o_orderkey long, day string").select("o_orderkey", F.to_timestamp_ntz("day").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    seen, expand = [], C.recurrence
    monkeypatch.setattr(C, "recurrence", lambda rules: seen.append(rules.count()) or expand(rules))
    got = sorted(tuple(r) for r in catalog.queries()["events_recurring"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
        assert got == sorted(db.execute(catalog.oracle_sql()["events_recurring"]).fetchall())
    assert seen == [15 * 2 + 1 + 1] and len({r[0] for r in got}) == 60  # by two starts, one of key 15, and that without a date


def test_total_return_rounds_halves_as_its_sql(spark, tmp_path):
    """(49.81 - 1.6) / 1.6 is 30.13125, a half at four places that its double misses by one bit."""
    import duckdb

    ticks = [(350, 1, 1.6), (350, 2, 49.81), (99, 1, 16.0), (99, 2, 9.26), (1163, 1, 19.84), (1163, 2, 78.74), (754, 1, 8.0), (754, 2, 13.37)]
    events = spark.createDataFrame(ticks, "user_id long, s long, value double").select("user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["series_id"], r["total_return"]) for r in catalog.queries()["total_return"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        assert got == set(db.execute(catalog.oracle_sql()["total_return"]).fetchall()) and (350, 30.1313) in got


def test_toeplitz_systems_and_erfc(spark):
    import numpy as np

    rng = random.Random(5)
    rows, want = [], {}
    for k in range(30):
        n = rng.randint(1, 7)
        first = [4.0 + n] + [rng.uniform(-1, 1) for _ in range(n - 1)]
        rhs = [rng.uniform(-5, 5) for _ in range(n)]
        rows.append((k, first, rhs))
        want[k] = np.linalg.solve([[first[abs(i - j)] for j in range(n)] for i in range(n)], rhs)
    for r in spark.createDataFrame(rows, "k int, a array<double>, b array<double>").select("k", stats.toeplitz_solve(F.col("a"), F.col("b")).alias("x")).collect():
        assert r["x"] == pytest.approx(list(want[r["k"]]), rel=1e-9, abs=1e-12)
    y = [0.0, 1.0]
    for i in range(400):
        y.append(1 + 0.5 * y[-1] + 0.3 * y[-2] + rng.gauss(0, 1))
    s = make(spark, y)
    fits = {r["order"]: r for r in stats.yule_walker(s, 4).collect()}
    z = np.array(y) - np.mean(y)
    g = [float((z[k:] * z[: len(z) - k]).sum()) for k in range(5)]
    for q in range(1, 5):
        phi = np.linalg.solve([[g[abs(i - j)] for j in range(q)] for i in range(q)], g[1 : q + 1])
        assert fits[q]["phi"] == pytest.approx(list(phi)) and fits[q]["c"] == pytest.approx((1 - phi.sum()) * np.mean(y))
    assert sum(r["chosen"] for r in fits.values()) == 1 and min(fits.values(), key=lambda r: r["aic"])["chosen"] and fits[1]["aic"] > fits[2]["aic"]
    for r in spark.createDataFrame([(x / 7,) for x in range(-30, 31)], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=2e-7)


def test_graph_reads_its_source_once(spark, tmp_path):
    """A diamond of derived series, nested transforms and installed features in one pass; unknown names and cycles are errors."""
    from ledgerlens.plans.metrics import Graph, before, return_graph

    make(spark, [1, 2, 4, 8, math.nan, 3]).write.parquet(str(tmp_path / "t"))
    g = return_graph()
    g.add("sum", ["base", "base::double"], lambda a, b: a + b)
    g.add("top", ["sum::diff", "sum"], lambda a, b: a + b)
    g.install("top::diff", "base::log")
    out = g.evaluate(spark.read.parquet(str(tmp_path / "t")), ["sum"])
    got = defaultdict(list)
    for r in out.orderBy("item", "t_ms").collect():
        got[r["item"]].append(round(r["value"], 6))
    assert got["sum"] == [3, 6, 12, 24, 9] and got["base::simple"] == [1, 1, 1] and got["top::diff"] == [9, 18] and len(got["base::log"]) == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    g.remove("top::diff")
    assert "top::diff" not in {r["item"] for r in g.evaluate(spark.read.parquet(str(tmp_path / "t")), []).collect()}
    with pytest.raises(KeyError):
        g.evaluate(out, ["base::nothing"])
    loop = Graph()
    loop.add("x", ["y"], lambda y: y)
    loop.add("y", ["x"], lambda x: before(x))
    with pytest.raises(ValueError):
        loop.evaluate(out, ["x"])


def test_correlations_by_blocks(spark):
    rng = random.Random(6)
    rows = [(f"s{k}", t * 1000, rng.gauss(0, 1) + (t / 9 if k % 2 else 0)) for k in range(7) for t in range(40) if rng.random() < 0.8]
    rows += [("flat", t * 1000, 5.0) for t in range(40)] + [("far", 10**9, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, t_ms long, value double")
    shown = lambda d: sorted((r["a"], r["b"], round(r["corr"], 9)) for r in d.collect() if r["corr"] is not None)
    for blocks, chunk in ((1, 10**12), (3, 7000)):
        assert shown(stats.correlation_blocks(df, n_blocks=blocks, chunk_ms=chunk)) == shown(stats.correlation_matrix(df))


def test_sketches_merge_within_their_error(spark):
    from ledgerlens.functions import sketches

    values = [random.Random(k).expovariate(1) for k in range(20_000)]
    df = spark.createDataFrame([("a", k * 1000, v) for k, v in enumerate(values)], "series_id string, t_ms long, value double")
    ordered = sorted(values)
    for bucket in (10**12, 500_000):  # one pass, and forty buckets merged
        cut = sketches.sketched(df, ["series_id"], bucket)
        for r in sketches.quantiles(sketches.merged(cut, ["series_id"]), ["series_id"], [0.01, 0.25, 0.5, 0.9, 0.999]).collect():
            rank = sum(v <= r["value"] for v in ordered) / len(ordered)
            assert abs(rank - r["share"]) <= 2 * sketches.rank_error()


def test_metadata_and_logs(spark, tmp_path):
    (tmp_path / "e.csv").write_text("ticker;name;denomination;exchange;sector\nABC;A b;USD;X;Tech\nDEF;D;EUR;Y;\n")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "ABC.attr").write_text("isin=US1\nnote=a=b\nno pair\n")
    got = {r["ticker"]: (r["denomination"], r["sector"], r["attributes"]) for r in files.read_equities(spark, str(tmp_path / "e.csv"), str(tmp_path / "a")).collect()}
    assert got == {"ABC": ("USD", "Tech", {"isin": "US1", "note": "a=b"}), "DEF": ("EUR", None, None)}
    (tmp_path / "c.csv").write_text("ticker;denomination\nUSD;USD\n")
    assert [tuple(r) for r in files.read_cash(spark, str(tmp_path / "c.csv")).collect()] == [("USD", "USD")]
    head = "id;timestampMs;type;asset_type;asset_ticker;quantity;price_per_unit;fees;settlement_currency\n"
    (tmp_path / "t.csv").write_text(head + "".join(f"{k};{k}000;Buy;Equity;ABC;1;2;0;USD\n" for k in (1, 2, 3)))
    assert sorted(r["id"] for r in files.read_transactions(spark, str(tmp_path / "t.csv"), 2000).collect()) == ["2", "3"]
