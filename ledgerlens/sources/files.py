"""Series, metadata, transaction logs and broker exports in files, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.series import finite, merge

SERIES = "timestamp long, value double"
EQUITIES = "ticker string, name string, denomination string, exchange string, sector string"
CASH = "ticker string, denomination string"
TRANSACTIONS = "id string, timestampMs long, type string, asset_type string, asset_ticker string, quantity double, price_per_unit double, fees double, settlement_currency string"
# The currencies and transaction types that are accepted.
CURRENCIES = ["USD", "EUR", "JPY", "KRW", "CAD", "GBP"]
TYPES = {"BUY": "Buy", "SELL": "Sell", "DIVIDEND": "Dividend", "DEPOSIT": "Deposit", "WITHDRAWAL": "Withdrawal"}


def _csv(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


def _write_csv(df: DataFrame, path: str, *by: str) -> None:
    df.write.partitionBy(*by).option("sep", ";").option("header", True).csv(path)


def _folder_value(part: Column) -> Column:
    """The value in the name of a partition folder: escaped once by Spark and once in the address of the file."""
    return F.url_decode(F.url_decode(part))


def read_series(spark: SparkSession, root: str) -> DataFrame:
    """All ``<root>/<series id>/<frequency>.csv`` files, or those of ``write_series``; rows that are not finite go."""
    raw = _csv(spark, SERIES, f"{root}/*/*")
    path = F.col("_metadata.file_path")
    plain = lambda k: F.regexp_extract(path, r"([^/]+)/(\d+)\.csv$", k)
    part = lambda k: F.regexp_extract(path, r"series_id=([^/]+)/freq_ms=(\d+)/[^/]+$", k)
    series = F.when(part(1) != "", _folder_value(part(1))).otherwise(F.url_decode(plain(1)))
    return raw.select(series.alias("series_id"), F.coalesce(part(2).try_cast("long"), plain(2).try_cast("long")).alias("freq_ms"), F.col("timestamp").alias("t_ms"), "value").where(finite(F.col("value")))


def write_series(df: DataFrame, root: str) -> None:
    """Series as semicolon-separated files in a folder for each series and frequency."""
    _write_csv(df.select("series_id", "freq_ms", F.col("t_ms").alias("timestamp"), "value").repartition("series_id", "freq_ms"), root, "series_id", "freq_ms")


def save_series(df: DataFrame, path: str) -> None:
    """Write series as Parquet by frequency and series, replacing those present; resampled data is refused."""
    if "is_synthetic" in df.columns and not df.where("is_synthetic").isEmpty():
        raise ValueError("resampled series are not stored")
    df.drop("is_synthetic").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("freq_ms").parquet(path)


def upsert_series(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The stored series with new rows merged in (new wins), ready to be saved."""
    return merge(spark.read.parquet(path).select("series_id", "freq_ms", "t_ms", "value"), new, ["series_id", "freq_ms"])


def read_equities(spark: SparkSession, path: str, attributes: str | None = None) -> DataFrame:
    """ticker;name;denomination;exchange;sector, with attributes from ``<ticker>.attr`` files of key=value lines."""
    out = _csv(spark, EQUITIES, path)
    if attributes is None:
        return out.withColumn("attributes", F.lit(None).cast("map<string,string>"))
    path_of = F.col("_metadata.file_path")
    part, plain = F.regexp_extract(path_of, r"ticker=([^/]+)/[^/]+$", 1), F.regexp_extract(path_of, r"([^/]+)\.attr$", 1)
    ticker = F.when(part != "", _folder_value(part)).otherwise(F.url_decode(plain))
    lines = spark.read.text(f"{attributes}/*").where(F.col("value").contains("=")).select(ticker.alias("ticker"), F.split("value", "=", 2).alias("kv"))
    maps = lines.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(F.col("kv")[0], F.col("kv")[1]))).alias("attributes"))
    return out.join(maps, "ticker", "left")


def write_equities(df: DataFrame, path: str, attributes: str) -> None:
    """The rows without their attributes as one table, the attributes as key=value lines in a folder for each ticker."""
    _write_csv(df.select("ticker", "name", "denomination", "exchange", "sector"), path)
    lines = df.select("ticker", F.explode("attributes").alias("k", "v")).select("ticker", F.concat_ws("=", "k", "v").alias("value"))
    lines.repartition("ticker").write.partitionBy("ticker").text(attributes)


def read_cash(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, CASH, path)


def write_cash(df: DataFrame, path: str) -> None:
    _write_csv(df.select("ticker", "denomination"), path)


def read_transactions(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """A transaction log; ``after`` is inclusive."""
    out = _csv(spark, TRANSACTIONS, path)
    return out if after is None else out.where(F.col("timestampMs") >= after)


def import_broker(spark: SparkSession, path: str, base: str = "EUR", ticker_currency: DataFrame | None = None) -> DataFrame:
    """Transactions of a broker's CSV export, in time order.

    Cash rows carry the symbol $$CASH_TX. Unknown types and dates that are not eight digits are skipped, blanks
    count 0, and the currency is the row's own if known, else the ticker's, else the base.
    """
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    cash = F.col("Symbol") == "$$CASH_TX"
    kind = F.upper(F.trim("Transaction Type"))
    allowed = F.when(cash, kind.isin("DEPOSIT", "WITHDRAWAL")).otherwise(kind.isin("BUY", "SELL", "DIVIDEND"))
    own = F.upper(F.col("Currency")) if "Currency" in raw.columns else F.lit(None).cast("string")
    rows = raw.where(F.trim("Trade Date").rlike(r"^\d{8}$") & allowed)
    rows = rows.join(ticker_currency.select(F.col("ticker").alias("_t"), F.col("currency").alias("_c")), F.col("Symbol") == F.col("_t"), "left") if ticker_currency is not None else rows.withColumn("_c", F.lit(None).cast("string"))
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    out = rows.select(
        F.unix_millis(F.to_timestamp(F.trim("Trade Date"), "yyyyMMdd")).alias("t_ms"), names[kind].alias("type"), F.when(~cash, F.col("Symbol")).alias("ticker"),
        number("Quantity").alias("quantity"), number("Purchase Price").alias("price"), number("Commission").alias("fee"),
        F.coalesce(F.when(own.isin(CURRENCIES), own), "_c", F.lit(base)).alias("currency"),
    )
    return out.withColumn("id", F.sha2(F.to_json(F.struct("*")), 256)).orderBy("t_ms")


def broker_rows(txns: DataFrame, *more: str) -> DataFrame:
    """Transactions in the columns of a broker's export, with further columns; the inverse of ``import_broker`` for its types."""
    return txns.select(
        F.coalesce("ticker", F.lit("$$CASH_TX")).alias("Symbol"), F.date_format(F.timestamp_millis("t_ms"), "yyyyMMdd").alias("Trade Date"), F.col("price").alias("Purchase Price"),
        F.col("quantity").alias("Quantity"), F.col("fee").alias("Commission"), F.upper("type").alias("Transaction Type"), F.col("currency").alias("Currency"), *more,
    )


def write_snapshots(holdings: DataFrame, path: str) -> None:
    """Nested snapshots: positions and cash of each (portfolio, instant) in one row."""
    cash = F.col("asset").startswith("CASH:")
    nested = holdings.groupBy("portfolio_id", "t_ms").agg(
        F.array_sort(F.collect_list(F.when(~cash, F.struct("asset", "quantity")))).alias("positions"),
        F.map_from_entries(F.collect_list(F.when(cash, F.struct(F.substring("asset", 6, 3), F.col("quantity"))))).alias("cash"),
    )
    nested.write.mode("overwrite").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The holdings of written snapshots, one row each."""
    s = spark.read.parquet(path)
    shares = s.select("portfolio_id", "t_ms", F.explode("positions").alias("p")).select("portfolio_id", "t_ms", "p.asset", "p.quantity")
    money = s.select("portfolio_id", "t_ms", F.explode("cash").alias("c", "quantity")).select("portfolio_id", "t_ms", F.concat(F.lit("CASH:"), "c").alias("asset"), "quantity")
    return shares.unionByName(money)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
