"""Sinks for panels, forecasts and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volarium.operators.panel import widen


def csv_table(df: DataFrame, path: str, header: bool = True, **options) -> str:
    df.write.options(header=header, **options).mode("overwrite").csv(path)
    return path


def wide_csv(panel: DataFrame, tickers: Sequence[str], path: str, value: str = "value", date_format: str = "yyyy-MM-dd") -> str:
    """Long panel to a wide CSV sorted by date, ticker columns in sorted order."""
    wide = widen(panel, tickers, value).orderBy("date").withColumn("date", F.date_format("date", date_format))
    return csv_table(wide, path)


def forecast_store(pred: DataFrame, path: str) -> str:
    """Append-safe store of forecasts: one folder per (run, origin), a re-run replaces only its own.

    Rebalancing gathers a folder's rows into few files and lets AQE split a folder that is too large.
    """
    (pred.hint("rebalance", "run", "origin").write.partitionBy("run", "origin")
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))
    return path


def quote_folders(quotes: DataFrame, path: str) -> str:
    """Quotes as CSV files, one folder per ticker and day."""
    quotes.hint("rebalance", "ticker", "date").write.partitionBy("ticker", "date").option("header", True).mode("overwrite").csv(path)
    return path
