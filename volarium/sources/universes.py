"""Named ticker universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Members of the two index universes.
DJIA = ["AAPL", "AMGN", "AXP", "BA", "CAT", "CRM", "CSCO", "CVX", "DIS", "GS", "HD", "HON", "IBM", "INTC", "JNJ", "JPM",
        "KO", "MCD", "MMM", "MRK", "MSFT", "NKE", "PG", "TRV", "UNH", "VZ", "WMT"]
SP100 = ["AAPL", "ABT", "ACN", "ADBE", "ADP", "AMGN", "AMT", "AMZN", "AXP", "BA", "BAC", "BDX", "BMY", "BSX", "C", "CAT",
         "CB", "CI", "CMCSA", "CME", "COP", "COST", "CRM", "CSCO", "CVS", "CVX", "D", "DHR", "DIS", "DUK", "FIS", "FISV",
         "GE", "GILD", "GOOG", "GS", "HD", "HON", "IBM", "INTC", "INTU", "ISRG", "JNJ", "JPM", "KO", "LLY", "LMT", "LOW",
         "MA", "MCD", "MDT", "MMM", "MO", "MRK", "MS", "MSFT", "NFLX", "NKE", "NVDA", "ORCL", "PEP", "PFE", "PG", "PNC", "QCOM",
         "SBUX", "SO", "SYK", "T", "TGT", "TJX", "TMO", "TXN", "UNH", "UNP", "UPS", "USB", "VZ", "WFC", "WMT"]
UNIVERSES = {"DJIA": DJIA, "DJIA30": DJIA, "SP100": SP100}
# The six-node example graph as undirected pairs.
SIX_NODE_PAIRS = [("AXP", "BA"), ("AXP", "CVX"), ("BA", "GS"), ("BA", "IBM"), ("CVX", "JPM"), ("GS", "IBM"),
                  ("GS", "JPM"), ("IBM", "JPM")]


def universe(spark: SparkSession, name: str) -> DataFrame:
    """(ticker) of a named universe, for a semi join."""
    if name not in UNIVERSES:
        raise ValueError(f"universe must be one of {sorted(UNIVERSES)}, found {name!r}")
    return spark.createDataFrame([(t,) for t in UNIVERSES[name]], "ticker string")
