"""Multi-scale lag features and forward targets on a dense panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volarium.operators.panel import by_ticker

# Look-back spans (first lag, last lag) of the day, week and month components.
NESTED = {"d": (1, 1), "w": (1, 5), "m": (1, 22)}
DISJOINT = {"d": (1, 1), "w": (2, 5), "m": (6, 22)}


def lag_mean(column: str, first: int, last: int, partial: bool = False) -> Column:
    """Mean of lags first..last over the table's dates.

    One missing lag makes the mean NULL unless `partial`; `avg` alone would skip it.
    """
    w = by_ticker().rowsBetween(-last, -first)
    mean = F.avg(column).over(w)
    return mean if partial else F.when(F.count(column).over(w) == last - first + 1, mean)


def har_features(dense: DataFrame, column: str = "value", har: str = "nested", prefix: str = "",
                 warmup: str = "null", gap: int = 0) -> DataFrame:
    """Add <prefix>d, <prefix>w, <prefix>m.

    har: ``nested`` means over 1, 5 and 22 dates; ``disjoint`` lag 1, lags 2-5, lags 6-22;
    ``partial`` the nested spans over whatever is available.
    warmup: ``zero`` writes 0 while fewer dates than the span exist, else NULL.
    gap: dates left out between the newest lag and the target.
    """
    spans = {"nested": NESTED, "partial": NESTED, "disjoint": DISJOINT}[har]
    out = {}
    for name, (first, last) in spans.items():
        first, last = first + gap, last + gap
        mean = lag_mean(column, first, last, partial=har == "partial")
        if warmup == "zero":
            mean = F.when(F.col("pos") < last, F.lit(0.0)).otherwise(mean)
        out[prefix + name] = mean
    return dense.withColumns(out)


def har_panel(dense: DataFrame, column: str = "value", har: str = "nested", exog: str | None = None) -> DataFrame:
    """Feature panel (date, pos, n_dates, ticker, target, d, w, m[, iv_d, iv_w, iv_m]) without NULL rows."""
    features = har_features(dense, column, har)
    names = ["d", "w", "m"]
    if exog:
        features = har_features(features, exog, har, prefix="iv_")
        names += ["iv_d", "iv_w", "iv_m"]
    keep = features.select("date", "pos", "n_dates", "ticker", F.col(column).alias("target"), *names)
    return keep.dropna("any", subset=["target", *names])


def forward_sum(dense: DataFrame, column: str, horizon: int, name: str = "target") -> DataFrame:
    """Sum over t..t+h-1, NULL unless the whole span is known."""
    w = by_ticker().rowsBetween(0, horizon - 1)
    return dense.withColumn(name, F.when(F.count(column).over(w) == horizon, F.sum(column).over(w)))


def forward_mean(dense: DataFrame, column: str, horizon: int, name: str = "target") -> DataFrame:
    """Mean over t+1..t+h, NULL unless the whole span is known."""
    w = by_ticker().rowsBetween(1, horizon)
    return dense.withColumn(name, F.when(F.count(column).over(w) == horizon, F.avg(column).over(w)))
