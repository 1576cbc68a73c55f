import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import calendar as C
from ledgerlens.operators import models as M
from ledgerlens.operators import valuation as P
from ledgerlens.plans.analysis_queries import analysis

DAY = 86_400_000


def test_one_instant_equals_a_tick_of_the_grid(spark):
    """Assets without a price or a currency, cash in another currency, assets first held or priced later, totals of zero."""
    held = spark.createDataFrame([(1, "A", 5, 2.0), (1, "A", 20, 3.0), (1, "B", 30, 1.0), (1, "CASH:EUR", 1, 10.0), (2, "A", 7, 1.0), (2, "A", 9, 0.0), (3, "X", 1, 4.0)], "portfolio_id int, asset string, t_ms long, quantity double")
    prices = spark.createDataFrame([("A", 0, 1.5), ("A", 12, 2.5), ("B", 25, 7.0)], "series_id string, t_ms long, value double")
    fx = spark.createDataFrame([("EUR", 8, 1.1), ("EUR", 16, 1.2)], "series_id string, t_ms long, value double")
    own = spark.createDataFrame([("A", "EUR"), ("B", "USD")], "asset string, currency string")
    grid = P.value_weights(held, prices, fx, own, (0, 40, 10))
    cols = ("portfolio_id", "asset", "quantity", "value", "total", "weight")
    for at in (0, 10, 20, 40):
        rows = [sorted(tuple(r) for r in df.select(*cols).collect()) for df in (grid.where(F.col("t_ms") == at), P.value_at(held, prices, fx, own, at))]
        assert rows[0] == rows[1] and len(rows[1]) == 5


def test_supplied_series_take_the_place_of_computed_ones(spark):
    """A supplied series counts as a whole, also for a portfolio without a computed one, and the features follow it."""
    schema = "portfolio_id int, t_ms long, nav double"
    nav = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 4.0)], schema)
    supplied = spark.createDataFrame([(2, 5, 10.0), (2, 6, 15.0), (3, 1, 1.0)], schema)
    out = P.override(nav, supplied)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1.0), (1, 2, 2.0), (2, 5, 10.0), (2, 6, 15.0), (3, 1, 1.0)]
    total = {r["portfolio_id"]: (r["t_ms"], r["value"]) for r in analysis(out).where("item = 'totalReturn'").collect()}
    assert total == {1: (2, 1.0), 2: (6, 0.5)}  # one tick has no return
    assert sorted(map(tuple, P.override(nav, supplied.limit(0)).collect())) == sorted(map(tuple, nav.collect()))


def test_only_failing_models_are_refitted(spark):
    """One series keeps its law and one changes it; a third has too few ticks for a model. Each goes on with its newest values."""
    rng = np.random.default_rng(3)

    def ar(n, phi, start=0.0):
        out = [start]
        for _ in range(n - 1):
            out.append(1.0 + phi * out[-1] + rng.normal(0, 0.1))
        return out

    calm = ar(200, 0.5)
    wild = ar(100, 0.5)
    wild += ar(100, -0.9, wild[-1])
    rows = [(s, t * 1000, float(v)) for s, xs in (("calm", calm), ("wild", wild), ("short", [1.0])) for t, v in enumerate(xs)]
    whole = spark.createDataFrame(rows, "series_id string, t_ms long, value double")
    models = M.fit_ols(whole.where("t_ms < 100000"), 1)
    got = {r["series_id"]: r for r in M.refit(whole, models, 1, 50, 0.1).collect()}
    old = {r["series_id"]: r for r in models.collect()}
    assert not got["calm"]["refitted"] and got["calm"]["phi"] == old["calm"]["phi"] and got["calm"]["rolling_mse"] < 0.1
    assert got["wild"]["refitted"] and got["wild"]["rolling_mse"] > 0.1
    y, x = np.array(wild[1:]), np.array(wild[:-1])
    slope, intercept = np.polyfit(x, y, 1)
    assert np.allclose([got["wild"]["phi"][0], got["wild"]["c"]], [slope, intercept])
    c, phi = old["wild"]["c"], old["wild"]["phi"][0]
    assert np.isclose(got["wild"]["rolling_mse"], np.mean((y[-50:] - c - phi * x[-50:]) ** 2))
    assert {s: r["context"] for s, r in got.items()} == {"calm": [calm[-1]], "wild": [wild[-1]]} and "short" not in got


def test_instants_at_an_offset(spark):
    """The civil day is that of the offset, not of UTC: late on Friday in UTC is Saturday nine hours on."""
    friday = 4 * DAY * 7 + 1 * DAY  # 1970-01-30
    days = spark.createDataFrame([(friday + 20 * 3_600_000,), (friday,), (friday - DAY,), (-1,)], "t_ms long")
    shut = spark.createDataFrame([("1970-01-29",), ("1970-01-29",)], "day string").select(F.to_date("day").alias("day"))
    rows = lambda offset: {r["t_ms"]: (str(r["day"]), r["open"]) for r in C.at_trading_days(days, shut, offset).collect()}
    assert rows(0) == {friday + 72_000_000: ("1970-01-30", True), friday: ("1970-01-30", True), friday - DAY: ("1970-01-29", False), -1: ("1969-12-31", True)}
    assert rows(9 * 3_600_000)[friday + 72_000_000] == ("1970-01-31", False)


def test_recurrences_keep_their_time_of_day(spark):
    """Days are clamped to the month, times stay, and an occurrence later in the day than the end does not count."""
    ms = lambda x: int(np.datetime64(x, "ms").astype(int))
    rules = [("m", "2024-01-31T18:00", "2024-04-30T18:00", "month", 1), ("n", "2024-01-31T18:00", "2024-04-30T17:59", "month", 1), ("d", "1969-12-30T01:00", "1970-01-01T00:00", "day", 1), ("y", "2024-02-29T00:30", "2026-12-31T00:00", "year", 1), ("x", "2024-01-02T00:00", "2024-01-01T00:00", "week", 2)]
    frame = spark.createDataFrame([(i, ms(a), ms(b), u, s) for i, a, b, u, s in rules], "id string, start_ms long, end_ms long, unit string, step int")
    got = {}
    for r in C.recurrence_at(frame).collect():
        got.setdefault(r["id"], []).append(r["t_ms"])
    want = {"m": ["2024-01-31T18:00", "2024-02-29T18:00", "2024-03-31T18:00", "2024-04-30T18:00"], "n": ["2024-01-31T18:00", "2024-02-29T18:00", "2024-03-31T18:00"], "d": ["1969-12-30T01:00", "1969-12-31T01:00"], "y": ["2024-02-29T00:30", "2025-02-28T00:30", "2026-02-28T00:30"]}
    assert {k: sorted(v) for k, v in got.items()} == {k: [ms(x) for x in v] for k, v in want.items()}
