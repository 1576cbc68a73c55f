"""The engine's tables derived from the driver's: series, prices, rates, transactions; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import stored

DAY = 86_400_000
HOUR = 3_600_000
# Currencies by brand number modulo 6, and the currency of each order priority.
CURRENCIES = ["USD", "EUR", "JPY", "KRW", "CAD", "GBP"]
PRIORITIES = {"1-URGENT": "EUR", "2-HIGH": "JPY", "3-MEDIUM": "KRW", "4-NOT SPECIFIED": "CAD", "5-LOW": "GBP"}
#: A grid of 30 days over the years of the orders: 1995-01-01 to 2001-12-01.
GRID = (788_918_400_000, 1_007_164_800_000, 30 * DAY)
SPLIT_AT = 899_251_200_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def series(spark, d) -> DataFrame:
    """Irregular series of each user."""
    return table(spark, d, "events").select(F.col("user_id").alias("series_id"), ms("ts").alias("t_ms"), "value")


def by_type(spark, d) -> DataFrame:
    """Hourly means of each event type: few, regular, longer series."""
    e = table(spark, d, "events").select(F.col("event_type").alias("series_id"), (F.floor(ms("ts") / HOUR) * HOUR).alias("t_ms"), "value")
    return e.groupBy("series_id", "t_ms").agg(F.avg("value").alias("value"))


def buckets(spark, d) -> DataFrame:
    """Each user's series at three frequencies: as it is, last of the hour, last of the day."""
    s = series(spark, d)
    out = s.select("series_id", F.lit(60_000).cast("long").alias("freq_ms"), "t_ms", "value")
    for f in (HOUR, DAY):
        coarse = s.groupBy("series_id", (F.floor(F.col("t_ms") / f) * f).alias("b")).agg(F.max_by("value", "t_ms").alias("value"))
        out = out.unionByName(coarse.select("series_id", F.lit(f).cast("long").alias("freq_ms"), F.col("b").alias("t_ms"), "value"))
    return out


def user_grid(spark, d, step: int = HOUR) -> DataFrame:
    """Whole hours within each user's range."""
    r = series(spark, d).groupBy("series_id").agg((F.ceil(F.min("t_ms") / step) * step).alias("begin"), F.max("t_ms").alias("end"))
    from ..operators.resample import grid_regular

    return grid_regular(r.where("begin <= end"), step)


def denomination(spark, d) -> DataFrame:
    n = F.substring("p_brand", 7, 10).cast("int") % 6
    return table(spark, d, "part").select(F.col("p_brand").alias("asset"), F.get(F.array(*map(F.lit, CURRENCIES)), n).alias("currency")).distinct()


def prices(spark, d) -> DataFrame:
    """Mean unit price of each brand and ship day."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    l = table(spark, d, "lineitem").select("l_partkey", ms("l_shipdate").alias("t_ms"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("series_id"), "t_ms").agg(F.avg("x").alias("value"))


def fx(spark, d) -> DataFrame:
    ccy = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])[F.col("o_orderpriority")]
    return table(spark, d, "orders").groupBy(ccy.alias("series_id"), ms("o_orderdate").alias("t_ms")).agg((F.avg("o_totalprice") / 150000).alias("value"))


def txns(spark, d) -> DataFrame:
    """Transactions of one portfolio a nation."""
    moves = _moves(spark, d)
    return moves.unionByName(_splits(moves))


def stored_txns(spark, d, path: str) -> DataFrame:
    """The same, written below ``path``, for what reads them several times: tables are joined once."""
    moves = stored(_moves(spark, d), f"{path}/moves")
    stored(_splits(moves), f"{path}/splits")
    return spark.read.schema(moves.schema).parquet(f"{path}/moves", f"{path}/splits")


def _moves(spark, d) -> DataFrame:
    """Deposits and trades."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    oc = o.join(c, o.o_custkey == c.c_custkey)
    zero = F.lit(0.0)
    deposits = oc.select(F.col("c_nationkey").alias("portfolio_id"), ms("o_orderdate").alias("t_ms"), F.lit("Deposit").alias("type"), F.lit(None).cast("string").alias("ticker"), F.col("o_totalprice").alias("quantity"), zero.alias("price"), zero.alias("fee"), F.lit("USD").alias("currency"), F.concat(F.lit("D-"), F.col("o_orderkey").cast("string")).alias("id"))
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    l = table(spark, d, "lineitem").join(oc.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    div = (F.col("l_linestatus") == "F") & (F.col("l_tax") == 0)
    kind = F.when(div, "Dividend").when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy")
    ident = F.concat_ws("-", F.lit("L"), *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    trades = l.join(denomination(spark, d), F.col("p_brand") == F.col("asset")).select(
        F.col("c_nationkey").alias("portfolio_id"), ms("l_shipdate").alias("t_ms"), kind.alias("type"), F.col("p_brand").alias("ticker"), F.when(div, zero).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(div, F.col("l_discount")).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_tax") * 10).alias("fee"), "currency", ident.alias("id"),
    )
    return deposits.unionByName(trades)


def _splits(moves: DataFrame) -> DataFrame:
    """One split of each asset that a portfolio trades."""
    zero = F.lit(0.0)
    return moves.where("ticker IS NOT NULL").select("portfolio_id", "ticker", "currency").distinct().select(
        "portfolio_id", F.lit(SPLIT_AT).alias("t_ms"), F.lit("Split").alias("type"), "ticker", F.lit(2.0).alias("quantity"), zero.alias("price"), zero.alias("fee"), "currency", F.concat(F.lit("S-"), "ticker").alias("id"),
    )


def grid(spark) -> DataFrame:
    begin, end, step = GRID
    return spark.range(begin, end + 1, step).select(F.col("id").alias("t_ms"))


_CASE = "CASE CAST(substr(p_brand, 7) AS INT) % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CURRENCIES)) + " END"
_PRIO = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITIES.items()) + " END"
#: The same tables as named parts of a WITH clause.
CTE = {
    "s": "SELECT user_id AS series_id, (epoch_us(ts) // 1000) AS t_ms, value FROM events",
    "st": f"SELECT event_type AS series_id, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS t_ms, avg(value) AS value FROM events GROUP BY 1, 2",
    "sb": f"SELECT series_id, 60000 AS freq_ms, t_ms, value FROM s UNION ALL SELECT series_id, {HOUR}, t_ms // {HOUR} * {HOUR}, max_by(value, t_ms) FROM s GROUP BY series_id, t_ms // {HOUR} UNION ALL SELECT series_id, {DAY}, t_ms // {DAY} * {DAY}, max_by(value, t_ms) FROM s GROUP BY series_id, t_ms // {DAY}",
    "ug": f"SELECT series_id, unnest(generate_series(b, e, {HOUR})) AS t_ms FROM (SELECT series_id, CAST(ceil(min(t_ms) / {HOUR}.0) AS BIGINT) * {HOUR} AS b, max(t_ms) AS e FROM s GROUP BY 1) WHERE b <= e",
    "den": f"SELECT DISTINCT p_brand AS asset, {_CASE} AS currency FROM part",
    "p": "SELECT p_brand AS series_id, (epoch_us(l_shipdate) // 1000) AS t_ms, avg(l_extendedprice / l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "fx": f"SELECT {_PRIO} AS series_id, (epoch_us(o_orderdate) // 1000) AS t_ms, avg(o_totalprice) / 150000 AS value FROM orders GROUP BY 1, 2",
    "tr": """SELECT c_nationkey AS portfolio_id, (epoch_us(l_shipdate) // 1000) AS t_ms, CASE WHEN l_linestatus = 'F' AND l_tax = 0 THEN 'Dividend' WHEN l_returnflag = 'R' THEN 'Sell' ELSE 'Buy' END AS type, p_brand AS ticker,
      CASE WHEN l_linestatus = 'F' AND l_tax = 0 THEN 0 ELSE l_quantity END AS quantity, CASE WHEN l_linestatus = 'F' AND l_tax = 0 THEN l_discount ELSE l_extendedprice / l_quantity END AS price, l_tax * 10 AS fee, currency,
      concat_ws('-', 'L', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN den ON p_brand = asset""",
    "txn": f"""SELECT c_nationkey AS portfolio_id, (epoch_us(o_orderdate) // 1000) AS t_ms, 'Deposit' AS type, NULL AS ticker, o_totalprice AS quantity, 0.0 AS price, 0.0 AS fee, 'USD' AS currency, 'D-' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL SELECT * FROM tr UNION ALL SELECT DISTINCT portfolio_id, {SPLIT_AT}, 'Split', ticker, 2.0, 0.0, 0.0, currency, 'S-' || ticker FROM tr""",
    "tp": "SELECT *, CASE type WHEN 'Deposit' THEN 0 WHEN 'Dividend' THEN 1 WHEN 'Buy' THEN 2 WHEN 'Sell' THEN 2 WHEN 'Withdrawal' THEN 3 WHEN 'Split' THEN 4 ELSE 5 END AS pr FROM txn",
    "pr1": "SELECT *, product(CASE WHEN type = 'Split' THEN quantity ELSE 1 END) OVER (PARTITION BY portfolio_id, ticker ORDER BY t_ms, pr, id ROWS UNBOUNDED PRECEDING) AS r FROM tp WHERE type NOT IN ('Deposit', 'Withdrawal')",
    "pr2": "SELECT *, r * sum(CASE type WHEN 'Buy' THEN quantity WHEN 'Sell' THEN -quantity ELSE 0 END / r) OVER (PARTITION BY portfolio_id, ticker ORDER BY t_ms, pr, id ROWS UNBOUNDED PRECEDING) AS position FROM pr1",
    "pos": "SELECT *, coalesce(lag(position) OVER (PARTITION BY portfolio_id, ticker ORDER BY t_ms, pr, id), 0) AS held FROM pr2",
    "cd": """SELECT portfolio_id, t_ms, pr, type, id, currency, CASE WHEN type = 'Buy' THEN -(quantity * price + fee) WHEN type = 'Sell' THEN quantity * price - fee WHEN type = 'Dividend' AND held <> 0 THEN held * price - fee ELSE 0 END AS delta FROM pos
      UNION ALL SELECT portfolio_id, t_ms, pr, type, id, currency, CASE WHEN type = 'Deposit' THEN quantity - fee ELSE -(quantity + fee) END FROM tp WHERE type IN ('Deposit', 'Withdrawal')""",
    "hold": """SELECT portfolio_id, ticker AS asset, t_ms, arg_max(position, (pr, id)) AS quantity FROM pos GROUP BY 1, 2, 3
      UNION ALL SELECT portfolio_id, 'CASH:' || currency, t_ms, CAST(sum(sum(CAST(delta AS DECIMAL(28,4)))) OVER (PARTITION BY portfolio_id, currency ORDER BY t_ms) AS DOUBLE) FROM cd GROUP BY portfolio_id, currency, t_ms""",
    "g": f"SELECT unnest(generate_series({GRID[0]}, {GRID[1]}, {GRID[2]})) AS t_ms",
    "pg": "SELECT k.series_id, g.t_ms, coalesce(x.value, f.value) AS value FROM (SELECT series_id, arg_min(value, t_ms) AS value FROM p GROUP BY 1) k JOIN g ON true JOIN (SELECT series_id, arg_min(value, t_ms) AS value FROM p GROUP BY 1) f USING (series_id) ASOF LEFT JOIN p x ON k.series_id = x.series_id AND g.t_ms >= x.t_ms",
    "fg": "SELECT k.series_id, g.t_ms, coalesce(x.value, k.value) AS value FROM (SELECT series_id, arg_min(value, t_ms) AS value FROM fx GROUP BY 1) k JOIN g ON true ASOF LEFT JOIN fx x ON k.series_id = x.series_id AND g.t_ms >= x.t_ms",
    "hg": "SELECT k.portfolio_id, k.asset, g.t_ms, coalesce(h.quantity, 0) AS quantity FROM (SELECT DISTINCT portfolio_id, asset FROM hold) k JOIN g ON true ASOF LEFT JOIN hold h ON k.portfolio_id = h.portfolio_id AND k.asset = h.asset AND g.t_ms >= h.t_ms",
    "val": """SELECT hg.portfolio_id, hg.asset, hg.t_ms, hg.quantity, hg.quantity * coalesce(pg.value, 1) * coalesce(fg.value, 1) AS value FROM hg LEFT JOIN den ON hg.asset = den.asset
      LEFT JOIN pg ON pg.series_id = hg.asset AND pg.t_ms = hg.t_ms LEFT JOIN fg ON fg.series_id = CASE WHEN hg.asset LIKE 'CASH:%' THEN substr(hg.asset, 6, 3) ELSE den.currency END AND fg.t_ms = hg.t_ms""",
    "vw": "SELECT *, CAST(sum(CAST(value AS DECIMAL(28,4))) OVER (PARTITION BY portfolio_id, t_ms) AS DOUBLE) AS total FROM val",
    "lr": "SELECT series_id, t_ms, CASE WHEN b > 0 AND value > 0 THEN ln(value / b) END AS value FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t_ms) AS b, row_number() OVER (PARTITION BY series_id ORDER BY t_ms) AS r FROM p) WHERE r > 1",
    "cal": "SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) x(d)",
    "hol": "SELECT day FROM cal WHERE (month(day) = 1 AND day(day) = 1) OR (isodow(day) < 6 AND day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders))",
    "td": "SELECT day FROM cal WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM hol)",
    "rt": "SELECT day, min(t) FILTER (t >= day) AS following, max(t) FILTER (t <= day) AS preceding FROM cal, (SELECT day AS t FROM td) GROUP BY day",
}
_NEEDS = {
    "sb": ["s"], "ug": ["s"], "tr": ["den"], "txn": ["tr"], "tp": ["txn"], "pr1": ["tp"], "pr2": ["pr1"], "pos": ["pr2"], "cd": ["pos", "tp"], "hold": ["pos", "cd"], "pg": ["p", "g"], "fg": ["fx", "g"],
    "hg": ["hold", "g"], "val": ["hg", "pg", "fg", "den"], "vw": ["val"], "lr": ["p"], "hol": ["cal"], "td": ["hol", "cal"], "rt": ["cal", "td"],
}


def sql(parts: str, body: str) -> str:
    """``body`` with the named parts, and all that they need, before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in parts.split():
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + body


def holidays(spark, d) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("2001-12-31")))).alias("day"))
    busy = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    idle = days.where(F.weekday("day") < 5).join(busy, "day", "left_anti")
    return idle.unionByName(days.where((F.month("day") == 1) & (F.dayofmonth("day") == 1))).distinct()
