"""Registered queries over files: tables written in the form of each source, with its usual faults, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..sources.folders import shared_folder
from . import views as V
from .core_queries import K, exact, exact_sql, r6
from .views import DAY, HOUR, sql

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, run, oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


def _series_files(spark, d) -> DataFrame:
    """Hourly means of each event type, and their daily maxima; some values are not numbers, or infinite."""
    path = shared_folder(spark)
    hours = V.by_type(spark, d)
    days = hours.groupBy(K, (F.floor(F.col("t_ms") / DAY) * DAY).alias("t_ms")).agg(F.max("value").alias("value"))
    h = F.floor(F.col("t_ms") / HOUR)
    faulty = F.when(h % 17 == 3, float("nan")).when(h % 19 == 4, float("inf")).otherwise(F.col("value"))
    files.write_series(hours.withColumns({"freq_ms": F.lit(HOUR), "value": faulty}).unionByName(days.withColumn("freq_ms", F.lit(DAY))), path)
    return r6(files.read_series(spark, path), "value")


add("scan_series_csv", _series_files, sql("st", f"SELECT series_id, CAST({HOUR} AS BIGINT) AS freq_ms, t_ms, round(value, 6) + 0.0 AS value FROM st WHERE (t_ms // {HOUR}) % 17 <> 3 AND (t_ms // {HOUR}) % 19 <> 4 UNION ALL SELECT series_id, {DAY}, t_ms // {DAY} * {DAY}, round(max(value), 6) + 0.0 FROM st GROUP BY series_id, t_ms // {DAY}"))


def _equities(spark, d) -> DataFrame:
    """Brands with a name, currency, exchange and sector; those of even sizes in all also with attributes, one of which holds the separator."""
    path = shared_folder(spark)
    facts = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("asset")).agg(F.min("p_name").alias("name"), F.max("p_type").alias("sector"), F.sum("p_size").alias("size"), F.count("*").alias("n"))
    shown = F.create_map(F.lit("lots"), F.col("n").cast("string"), F.lit("note"), F.concat(F.lit("size="), F.col("size").cast("string")))
    rows = facts.join(V.denomination(spark, d), "asset").select(F.col("asset").alias("ticker"), "name", F.col("currency").alias("denomination"), F.concat(F.lit("X"), F.col("currency")).alias("exchange"), "sector", F.when(F.col("size") % 2 == 0, shown).alias("attributes"))
    files.write_equities(rows, f"{path}/equities", f"{path}/attributes")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return files.read_equities(spark, f"{path}/equities", f"{path}/attributes").withColumn("attributes", text)


add("scan_equity_meta", _equities, sql("den", "SELECT p_brand AS ticker, min(p_name) AS name, any_value(currency) AS denomination, 'X' || any_value(currency) AS exchange, max(p_type) AS sector, CASE WHEN sum(p_size) % 2 = 0 THEN concat('lots:', count(*), ',note:size=', sum(p_size)) END AS attributes FROM part JOIN den ON p_brand = asset GROUP BY 1"))


def _cash(spark, d) -> DataFrame:
    path = shared_folder(spark)
    files.write_cash(V.denomination(spark, d).select(F.concat("currency", F.lit("-cash")).alias("ticker"), F.col("currency").alias("denomination")).distinct(), path)
    return files.read_cash(spark, path)


add("scan_cash_meta", _cash, sql("den", "SELECT DISTINCT currency || '-cash' AS ticker, currency AS denomination FROM den"))


def _broker(spark, d) -> DataFrame:
    """The export of all transactions but splits, in which rows are marred by the length of their id.

    Unknown currencies and none, blank fees, kinds in lower case, dates of another form and unknown kinds.
    """
    path = shared_folder(spark)
    k, date, kind = F.col("k"), F.col("Trade Date"), F.col("Transaction Type")
    rows = files.broker_rows(V.txns(spark, d).where("type <> 'Split'").withColumn("k", F.length("id") % 7), "k")
    marred = rows.withColumns({
        "Currency": F.when(k == 1, F.lit("CHF")).when(k != 2, F.col("Currency")), "Commission": F.when(k != 3, F.col("Commission")),
        "Transaction Type": F.when(k == 4, F.lower(kind)).when(k == 6, F.lit("HOLD")).otherwise(kind), "Trade Date": F.when(k == 5, F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 4))).otherwise(date),
    })
    marred.drop("k").write.option("header", True).csv(path)
    own = V.denomination(spark, d).withColumnRenamed("asset", "ticker")
    return files.import_broker(spark, path, "EUR", own).drop("id").withColumns({c: exact(c, 4) for c in ("price", "fee")})


add("txn_import_broker_csv", _broker, sql("txn den", f"SELECT t_ms // {DAY} * {DAY} AS t_ms, type, ticker, quantity, {exact_sql('price', 4)} AS price, CASE WHEN length(id) % 7 = 3 THEN 0 ELSE {exact_sql('fee', 4)} END AS fee, CASE WHEN length(id) % 7 IN (1, 2) THEN coalesce(den.currency, 'EUR') ELSE txn.currency END AS currency FROM txn LEFT JOIN den ON asset = ticker WHERE type <> 'Split' AND length(id) % 7 NOT IN (5, 6)"))
