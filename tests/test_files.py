from pyspark.sql import functions as F

from ledgerlens.sources import files


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_series_round_trip(spark, tmp_path):
    """Names that have to be escaped in addresses survive; values that are not finite go; both layouts read alike."""
    names = ["a b", "Brand#1", "x%20y", "=3", "ü"]
    data = [(n, f, 1000 * k, v) for n in names for f in (1, 60_000) for k, v in enumerate((1.5, float("nan"), -2.0, float("inf"), None))]
    files.write_series(spark.createDataFrame(data, "series_id string, freq_ms long, t_ms long, value double"), str(tmp_path / "s"))
    cols = ("series_id", "freq_ms", "t_ms", "value")
    assert rows(files.read_series(spark, str(tmp_path / "s")), *cols) == sorted(((n, f, t, v) for n in names for f in (1, 60_000) for t, v in ((0, 1.5), (2000, -2.0))), key=str)
    (tmp_path / "p" / "Brand#1").mkdir(parents=True)
    (tmp_path / "p" / "Brand#1" / "60000.csv").write_text("timestamp;value\n1;2.5\n")
    assert rows(files.read_series(spark, str(tmp_path / "p")), *cols) == [("Brand#1", 60_000, 1, 2.5)]


def test_metadata_round_trip(spark, tmp_path):
    """Attributes hold the separator or nothing; a ticker without any has null; an attribute table without lines is no error."""
    schema = "ticker string, name string, denomination string, exchange string, sector string, attributes map<string,string>"
    data = [("A#1", "first; one", "USD", "X", None, {"k": "a=b", "empty": ""}), ("B", None, "EUR", "Y", "s", None)]
    files.write_equities(spark.createDataFrame(data, schema), str(tmp_path / "e"), str(tmp_path / "a"))
    back = {r["ticker"]: r for r in files.read_equities(spark, str(tmp_path / "e"), str(tmp_path / "a")).collect()}
    assert back["A#1"]["attributes"] == {"k": "a=b", "empty": ""} and back["A#1"]["name"] == "first; one" and back["B"]["attributes"] is None
    files.write_cash(spark.createDataFrame([("USD-cash", "USD")], "ticker string, denomination string"), str(tmp_path / "c"))
    assert rows(files.read_cash(spark, str(tmp_path / "c")), "ticker", "denomination") == [("USD-cash", "USD")]


def test_broker_round_trip(spark, tmp_path):
    """What is exported comes back, in time order; a cash row has no ticker."""
    day = 86_400_000
    data = [(3 * day, "Buy", "ABC", 5.0, 10.25, 0.5, "USD"), (day, "Deposit", None, 1000.0, 0.0, 0.0, "EUR"), (2 * day, "Dividend", "ABC", 0.0, 0.1, 0.0, "GBP")]
    frame = spark.createDataFrame(data, "t_ms long, type string, ticker string, quantity double, price double, fee double, currency string")
    files.broker_rows(frame).write.option("header", True).csv(str(tmp_path / "b"))
    got = [tuple(r) for r in files.import_broker(spark, str(tmp_path / "b")).drop("id").collect()]
    assert got == sorted(data)
    assert files.import_broker(spark, str(tmp_path / "b")).select(F.countDistinct("id")).first()[0] == 3
