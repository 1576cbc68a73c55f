"""ledgerlens: portfolio and time-series analytics as PySpark DataFrame functions."""
