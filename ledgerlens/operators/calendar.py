"""Trading days, rolling, recurrences and corporate events, as calendar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR_MS = 365.2425 * 86_400_000


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def trading_days(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """(day) of all weekdays from start to end that are not holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day")).where(is_weekday(F.col("day")))
    return days if holidays is None else days.join(holidays.select("day").distinct(), "day", "left_anti")


def at_trading_days(instants: DataFrame, holidays: DataFrame, offset_ms: int = 0) -> DataFrame:
    """Instants (t_ms, ...) with their civil day at an offset from UTC, and whether that is a weekday and no holiday (day)."""
    day = F.to_date(F.timestamp_millis(F.col("t_ms") + offset_ms))
    closed = holidays.select("day", F.lit(True).alias("_closed")).distinct()
    return instants.withColumn("day", day).join(closed, "day", "left").withColumn("open", is_weekday(F.col("day")) & F.col("_closed").isNull()).drop("_closed")


def roll_table(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """(day, following, preceding): the trading days at or next to every calendar day."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    open_days = trading_days(spark, start, end, holidays).withColumn("open", F.col("day"))
    # A calendar has some hundred rows a year, so one ordered pass is right.
    w = W.partitionBy(F.lit(0)).orderBy("day")
    return days.join(open_days, "day", "left").select(
        "day", F.first("open", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("following"), F.last("open", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("preceding")
    )


def roll(convention: str) -> Column:
    """The rolled day of a roll_table row; modified conventions stay in the month."""
    f, p, d = F.col("following"), F.col("preceding"), F.col("day")
    same = lambda x: F.trunc(x, "MM") == F.trunc(d, "MM")
    return {
        "unadjusted": d, "following": f, "preceding": p,
        "modified_following": F.when(same(f), f).otherwise(p), "modified_preceding": F.when(same(p), p).otherwise(f),
    }[convention]


def recurrence(rules: DataFrame) -> DataFrame:
    """Occurrences of rules (start, end dates, unit, step): start + k steps <= end, the day clamped to the month."""
    # A sequence to a negative number would count down: a rule that ends before it starts has no occurrence.
    count = F.when(F.col("unit").isin("day", "week"), F.datediff("end", "start")).otherwise(F.ceil(F.months_between("end", "start"))).cast("int")
    k = F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(0)))).alias("k")
    months = {"month": 1, "quarter": 3, "year": 12}
    day = F.when(F.col("unit") == "day", F.date_add("start", F.col("k") * F.col("step"))).when(F.col("unit") == "week", F.date_add("start", F.col("k") * F.col("step") * 7))
    for unit, n in months.items():
        day = day.when(F.col("unit") == unit, F.add_months("start", F.col("k") * F.col("step") * n))
    return rules.select("*", k).withColumn("day", day).where(F.col("day") <= F.col("end"))


def recurrence_at(rules: DataFrame) -> DataFrame:
    """Occurrences t_ms of rules (start_ms, end_ms, unit, step) in UTC; each keeps the start's time of day, and none is after the end."""
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(c) / 86_400_000).cast("int"))
    days = recurrence(rules.withColumns({"start": day("start_ms"), "end": day("end_ms")}))
    t = F.unix_date("day").cast("long") * 86_400_000 + F.pmod("start_ms", F.lit(86_400_000))
    return days.withColumn("t_ms", t).where(F.col("t_ms") <= F.col("end_ms")).drop("start", "end", "day", "k")


def events_to_transactions(events: DataFrame) -> DataFrame:
    """Dividends and coupons become Dividend rows of quantity 0, splits become Split rows."""
    split = F.col("kind") == "Split"
    return events.select(
        "ticker", "t_ms", F.when(split, F.lit("Split")).otherwise(F.lit("Dividend")).alias("type"),
        F.when(split, F.col("amount_per_unit")).otherwise(F.lit(0.0)).alias("quantity"), F.when(split, F.lit(0.0)).otherwise(F.col("amount_per_unit")).alias("price"), "currency",
    )
