"""Stored series and ledgers: only touched segments are rewritten, newest wins, and chains equal a full replay."""

import glob
import os
import random
import re

from pyspark.sql import functions as F

from ledgerlens.operators import chain as C
from ledgerlens.operators import ledger as L
from ledgerlens.sources.ledger_store import LOG, LedgerStore, assigned
from ledgerlens.sources.segments import DAY, SeriesStore
from ledgerlens.streaming import jobs


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/data/*/v*/_part=*/_era=*/*.parquet")}


def test_series_upsert_newest_wins_and_keeps_untouched_files(spark, tmp_path):
    path = str(tmp_path / "s")
    store = SeriesStore(spark, path, parts=4, era_days=1)
    df = lambda rows: spark.createDataFrame(rows, "series_id long, t_ms long, value double, arrived long")
    batches = [
        [(k, t * DAY, float(k + t), 1) for k in range(8) for t in range(4)],
        [(3, 2 * DAY, 99.0, 5), (3, 2 * DAY, 98.0, 4), (9, 7 * DAY, 1.0, 5)],  # two versions of a tick in one batch
        [(3, 2 * DAY, -1.0, 2), (0, 0, 7.0, 6)],  # the first was overtaken before it arrived
    ]
    want, before = {}, {}
    for n, rows in enumerate(batches):
        store.upsert(n, df(rows))
        store.upsert(n, df([(0, 0, -5.0, 99)]))  # a commit that is run again changes nothing
        for k, t, v, a in rows:
            want[k, t] = max(want.get((k, t), (0, 0.0)), (a, v))
        now = files(path)
        assert {k: v for k, v in now.items() if k in before} == before
        hit = {r for _, r in store.segments.entries("series").items()}
        assert n in hit and (n == 0 or 0 in hit)
        before = now
    assert {(r["series_id"], r["t_ms"]): (r["arrived"], r["value"]) for r in store.read().collect()} == want
    assert len([1 for v in store.segments.entries("series").values() if v == 2]) <= 2


def rows_of(rng, n, first=0, last=900, tag="x"):
    out = []
    for k in range(n):
        t = rng.randint(first, last) * DAY
        kind = rng.choice(["Deposit", "Buy", "Buy", "Sell", "Dividend", "Withdrawal", "Split"])
        ticker = None if kind in ("Deposit", "Withdrawal") else rng.choice("AB")
        out.append((rng.randint(1, 5), t, kind, ticker, 2.0 if kind == "Split" else float(rng.randint(1, 50)), rng.randint(1, 9) / 4, 0.25, rng.choice(["USD", "EUR"]), f"{tag}{k}"))
    return out


def state(df):
    rnd = lambda xs: tuple((x[0], round(x[1], 6)) for x in xs)
    return {(r["portfolio_id"], r["t_ms"]): (rnd(r["positions"]), rnd(r["cash"])) for r in df.collect()}


def test_chain_equals_a_fold(spark):
    log = sorted(rows_of(random.Random(1), 150), key=lambda r: (r[0], r[1], {"Deposit": 0, "Dividend": 1, "Buy": 2, "Sell": 2, "Withdrawal": 3, "Split": 4}[r[2]], r[8]))
    want, pos, cash, last = {}, {}, {}, None
    for p, t, kind, ticker, q, price, fee, ccy, _ in log:
        if p != last:
            pos, cash, last = {}, {}, p
        held = pos.get(ticker, 0.0)
        if ticker:
            pos[ticker] = {"Buy": held + q, "Sell": held - q, "Split": held * q}.get(kind, held)
        cash[ccy] = cash.get(ccy, 0.0) + {"Deposit": q - fee, "Withdrawal": -(q + fee), "Buy": -(q * price + fee), "Sell": q * price - fee, "Dividend": held * price - fee if held else 0.0}.get(kind, 0.0)
        want[p, t] = (tuple((a, round(x, 6)) for a, x in sorted(pos.items())), tuple((a, round(x, 6)) for a, x in sorted(cash.items())))
    assert state(C.chain(spark.createDataFrame(log, LOG))) == want


def test_changes_equal_a_full_replay(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "l")
    store, log = LedgerStore(spark, path, parts=3, era_days=180), {}
    df = lambda rows: spark.createDataFrame(rows, LOG)
    first = rows_of(rng, 120)
    store.change(0, df(first))
    log |= {(r[0], r[8]): r for r in first}
    for n in (1, 2):
        late = [r for r in rows_of(rng, 12, 300, 950, f"n{n}-") if r[0] < 4]
        again = [r[:4] + (77.0,) + r[5:] for r in rng.sample(first, 4) if (r[0], r[8]) in log]  # known ids: nothing changes
        gone = [k for k in rng.sample(sorted(log), 5) if log[k][1] > 400 * DAY]
        edits = [log[k][:4] + (log[k][4] + 1,) + log[k][5:] for k in gone[:2]]  # removed and added again: replaced
        again = [r for r in again if (r[0], r[8]) not in gone]
        store.change(n, df(late + late[:1] + again + edits), spark.createDataFrame(gone or [(0, "none")], "portfolio_id long, id string"))
        for k in gone:
            del log[k]
        log |= {(r[0], r[8]): r for r in late + edits}
        assert sorted(map(str, store.log().collect())) == sorted(map(str, df(list(log.values())).collect()))
        assert state(store.snapshots()) == state(C.chain(df(list(log.values()))))
    assert {r["made"] for r in store.snapshots().select("made").distinct().collect()} > {0}
    since = spark.createDataFrame([(2, 500 * DAY)], "portfolio_id long, since long")
    store.invalidate(3, since)
    left = state(store.snapshots())
    assert all(p != 2 or t < 500 * DAY for p, t in left) and left == {k: v for k, v in state(C.chain(df(list(log.values())))).items() if k[0] != 2 or k[1] < 500 * DAY}


def test_a_late_change_opens_no_log_before_its_base(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "l")
    store = LedgerStore(spark, path, parts=2, era_days=100)
    store.change(0, spark.createDataFrame(rows_of(random.Random(9), 80), LOG))
    before, opened = files(path), []
    read = store.segments.read
    monkeypatch.setattr(store.segments, "read", lambda table, wanted=None, version=None: opened.append((table, df := read(table, wanted, version))) or df)
    store.change(1, spark.createDataFrame([(1, 850 * DAY, "Buy", "A", 5.0, 1.0, 0.0, "USD", "late")], LOG))
    replayed = [df for table, df in opened if table == "log"][-1]
    eras = {int(re.search(r"_era=(\d+)", f)[1]) for f in replayed.inputFiles()}
    assert min(eras) >= 7 and {k: v for k, v in files(path).items() if k in before} == before
    assert set(store.segments.entries("snapshots").values()) == {0, 1} and max(e for (p, e), v in store.segments.entries("snapshots").items() if v == 0) >= 8  # the other part


def test_a_change_writes_its_own_rows_and_the_segments_that_lose_some(spark, tmp_path):
    """Added rows lie beside those of their segment; nothing that only the change needs stays on disk."""
    path = str(tmp_path / "l")
    store, df = LedgerStore(spark, path, parts=2, era_days=100), lambda rows: spark.createDataFrame(rows, LOG)
    first = rows_of(random.Random(4), 90)
    store.change(0, df(first))
    in_commit = lambda n: spark.read.parquet(f"{path}/data/log/v{n}").count()
    late = [(p, 850 * DAY, "Buy", "A", 5.0, 1.0, 0.0, "USD", f"late{p}") for p in range(1, 6)]
    store.change(1, df(late + late[:2] + first[:3]))  # some come twice, some are known
    assert in_commit(0) == 90 and in_commit(1) == 5
    both = [x for x in store.segments.held("log") if x[1] == 8]
    assert {v for _, _, v in both} == {0, 1} and sorted(map(str, store.log().collect())) == sorted(map(str, df(first + late).collect()))
    store.change(2, deletes=spark.createDataFrame([(1, "late1"), (1, "none")], "portfolio_id long, id string"))
    part = next(p for p, _ in store.segments.touched(store.segments.placed("log", df(late[:1]))))
    assert [x for x in store.segments.held("log") if x[:2] == (part, 8)] == [(part, 8, 2)] and in_commit(2) == sum(1 for p, e in ((r["_part"], r["_era"]) for r in store.segments.placed("log", df(first + late[1:])).collect()) if (p, e) == (part, 8))
    left = first + late[1:]
    assert sorted(map(str, store.log().collect())) == sorted(map(str, df(left).collect())) and state(store.snapshots()) == state(C.chain(df(left)))
    assert not glob.glob(f"{path}/stage/*")


def test_holdings_by_sums_of_instants_equal_the_row_by_row_ledger(spark):
    """Many rows an instant, equal dividends that are each rounded, purchases paid elsewhere, rows without ticker or currency."""
    rng = random.Random(12)
    rows = [r[:5] + (rng.choice([0.33335, 0.1, 2.5]), rng.choice([0.0, 0.00003])) + (rng.choice([r[7], r[7], None]), r[8], rng.choice([None, "JPY"]), 7.125) for r in rows_of(rng, 400, 0, 12)]
    rows += [r[:2] + ("Dividend", None) + r[4:8] + (f"n{k}", *r[9:]) for k, r in enumerate(rows[:5])]
    log = spark.createDataFrame(rows, LOG + ", used_currency string, payment_price double")
    want = {}
    for r in L.positions(log).where("ticker IS NOT NULL").orderBy("t_ms", L.priority(F.col("type")), "id").collect():
        want[r["portfolio_id"], r["ticker"], r["t_ms"]] = r["position"]
    for r in L.cash(log).where("currency IS NOT NULL").orderBy("t_ms", L.priority(F.col("type")), "id").collect():
        want[r["portfolio_id"], "CASH:" + r["currency"], r["t_ms"]] = r["balance"]
    got = {(r["portfolio_id"], r["asset"], r["t_ms"]): r["quantity"] for r in L.holdings(log).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    assert "SortAggregate" not in L.holdings(log)._jdf.queryExecution().executedPlan().toString()


def test_assigned_ids_tell_transactions_apart(spark):
    df = spark.createDataFrame(rows_of(random.Random(2), 40) * 2, LOG)
    assert assigned(df).select("id").distinct().count() == 40 == assigned(df).where(F.col("id").rlike("^tx-[0-9a-f]{24}$")).select("id").distinct().count()


def test_streams_equal_their_batch_twins(spark, tmp_path):
    log = rows_of(random.Random(5), 60)
    waves = [log[:40], log[30:50] + log[45:], log[10:12]]  # late and repeated transactions
    schema = spark.createDataFrame([], LOG).schema
    for rows in waves:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "tx"))
        jobs.repair_ledger(spark.readStream.schema(schema).parquet(str(tmp_path / "tx")), str(tmp_path / "l"), str(tmp_path / "c1"), 2, 365).awaitTermination()
    store = LedgerStore(spark, str(tmp_path / "l"), 2, 365)
    assert state(store.snapshots()) == state(C.chain(spark.createDataFrame(log, LOG))) and store.segments.version() == 2


def test_forecast_monitor_with_late_missing_and_repeated_actuals(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    models = session.createDataFrame([("a", 1.0, [0.5, 0.25], [4.0, 2.0], 0, 100), ("b", 0.0, [1.0, 0.0], [3.0, 3.0], 50, 10)], "series_id string, c double, phi array<double>, context array<double>, t0 long, dt long")
    rng = random.Random(8)
    rows = []
    for s, t0, dt in (("a", 0, 100), ("b", 50, 10)):
        for k in range(1, 30):
            if k % 7:  # the others never come
                wave = min(3, k // 10 + (k % 5 == 1))
                t, v = t0 + k * dt + rng.choice([-1, 0, 1, dt // 3]), rng.uniform(0, 6)  # some too far off
                rows += [(s, t, v, wave)] + [(s, t, v + 1, min(3, wave + 1))] * (k % 4 == 0)
    arrivals = session.createDataFrame(rows, "series_id string, t_ms long, value double, wave int")
    for n in range(4):
        arrivals.where(F.col("wave") == n).drop("wave").write.mode("append").parquet(str(tmp_path / "in"))
        stream = session.readStream.schema(arrivals.drop("wave").schema).parquet(str(tmp_path / "in"))
        seen = jobs.monitor_forecasts(stream, models, 25, 5, 2.5, 1, 60)
        seen.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["series_id"], r["t_ms"]): (r["status"], r["actual"], round(r["rolling_mse"] or 0, 9), r["refit"]) for r in session.read.schema(jobs.MONITORED).parquet(str(tmp_path / "out")).collect()}
    forecasts = []
    for s, c, phi, window, t0, dt in (tuple(r) for r in models.collect()):
        for k in range(1, 26):
            window = [c + phi[0] * window[0] + phi[1] * window[1], window[0]]
            forecasts.append((s, t0 + k * dt, window[0]))
    twin = jobs.batch_monitor(arrivals, session.createDataFrame(forecasts, "series_id string, t_ms long, predicted double"), models, 5, 2.5, 1, 60)
    want = {(r["series_id"], r["t_ms"]): (r["status"], r["actual"], round(r["rolling_mse"] or 0, 9), r["refit"]) for r in twin.collect()}
    assert got == want and {x[0] for x in got.values()} == {"matched", "dropped"} and True in {x[3] for x in got.values()}
