"""Negative controls and checks: uninformative stand-ins for an input, and cross-lag regressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volarium.functions.scalars import keyed_normal
from volarium.operators.graph import correlations, cross_moments, propagate
from volarium.operators.panel import by_ticker
from volarium.operators.regress import coefficients_long, fit_ols, gram_names, gram_terms, predict, r_squared, solve_gram
from volarium.session import Staged, attach, stage

# Fixed value: seed of the published control series.
PSEUDO_SEED = 123


def pseudo_series(panel: DataFrame, train: DataFrame, columns: Sequence[str], seed: int = PSEUDO_SEED) -> DataFrame:
    """Replace each column by a Gaussian series with the ticker's training mean and deviation.

    One column gives a pseudo input whose lags can be built; several columns (lag components) are
    drawn independently. A draw depends on (seed, column, ticker, date) only.
    """
    stats = stage(train.groupBy("ticker").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_samp(c).alias(f"std_{c}") for c in columns]), "levels")
    drawn = attach(panel, stats, ["ticker"])
    return drawn.withColumns({
        c: F.col(f"mean_{c}") + F.col(f"std_{c}") * keyed_normal(F.lit(f"{seed}-{c}"), "ticker", "date") for c in columns
    }).drop(*[f"{k}_{c}" for k in ("mean", "std") for c in columns])


def factor_pseudo_series(panel: DataFrame, train: DataFrame, value: str, seed: int = PSEUDO_SEED) -> DataFrame:
    """Like `pseudo_series` for one column, with the tickers correlated through one shared factor.

    A ticker's loading is the correlation of its training values with the mean of all tickers by date. Its noise is loading * factor +
    sqrt(1 - loading^2) * own draw, so two tickers correlate by the product of their loadings. Both draws are keyed, the factor by the
    date alone, so every task draws the same one: nothing of size tickers x tickers is built, and levels are one join by ticker.
    A ticker without variation has loading 0.
    """
    market = stage(train.groupBy("date").agg(F.avg(value).alias("market")), "market")
    against = attach(train.select("date", "ticker", value).where(F.col(value).isNotNull()), market, ["date"])
    stats = stage(against.groupBy("ticker").agg(F.avg(value).alias("mean__"), F.stddev_samp(value).alias("std__"),
                                                 F.try_divide(F.covar_pop(value, "market"), F.stddev_pop(value) * F.stddev_pop("market")).alias("corr__")), "levels")
    load = F.when(F.col("corr__").isNull() | F.isnan("corr__"), 0.0).otherwise(F.greatest(F.least("corr__", F.lit(1.0)), F.lit(-1.0)))
    noise = load * keyed_normal(F.lit(f"{seed}-{value}-factor"), "date") + F.sqrt(1 - load * load) * keyed_normal(F.lit(f"{seed}-{value}"), "ticker", "date")
    drawn = attach(panel, stats, ["ticker"])
    return drawn.withColumn(value, F.col("mean__") + F.col("std__") * noise).drop("mean__", "std__", "corr__")


def cholesky_edges(panel: DataFrame, value: str) -> DataFrame:
    """Lower Cholesky factor of the ticker correlation as an edge list (src = column, dst = row).

    Correlations come from the blocked aggregation; the factor itself is one N x N problem.
    """
    moments = cross_moments(panel, value, [])
    pairs = correlations(moments).select("src", "dst", "corr")

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf.src.to_numpy(), pdf.dst.to_numpy()]))
        i, j = np.searchsorted(names, pdf.src), np.searchsorted(names, pdf.dst)
        c = np.eye(len(names))
        c[i, j] = c[j, i] = pdf["corr"]
        values, vectors = np.linalg.eigh(c)
        lower = np.linalg.cholesky((vectors * np.maximum(values, 1e-10)) @ vectors.T)
        r, k = np.nonzero(lower)
        return pd.DataFrame({"graph": "cholesky", "src": names[k], "dst": names[r], "w": lower[r, k]})

    return pairs.groupBy().applyInPandas(factor, "graph string, src string, dst string, w double")


def correlated_pseudo_series(panel: DataFrame, train: DataFrame, value: str, seed: int = PSEUDO_SEED) -> DataFrame:
    """Like `pseudo_series` for one column, with the training correlation between tickers kept."""
    factor = stage(cholesky_edges(train, value), "cholesky")
    noise = panel.select("date", "ticker", keyed_normal(F.lit(f"{seed}-{value}"), "ticker", "date").alias("z"))
    mixed = propagate(noise, factor, ["z"])
    stats = stage(train.groupBy("ticker").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")), "levels")
    out = attach(mixed, stats, ["ticker"])
    return out.select("date", "ticker", (F.col("mean") + F.col("std") * F.col("z")).alias(value))


def cross_lag_check(dense: DataFrame, target: str, regressors: Sequence[tuple[str, int]], value: str = "value",
                    head: int = 0) -> tuple[Staged, DataFrame]:
    """Regress a ticker on lag-1 values of tickers raised to given powers: (coefficients, R2).

    One conditional aggregation by date lines the series up; no self-join.
    """
    lagged = dense.withColumn("lag1", F.lag(value).over(by_ticker())).filter(F.col("pos") > head)
    names = [f"x{k}" for k in range(len(regressors))]
    rows = lagged.groupBy("date").agg(
        F.max(F.when(F.col("ticker") == target, F.col(value))).alias("target"),
        *[F.max(F.when(F.col("ticker") == t, F.pow("lag1", F.lit(float(p))))).alias(n)
          for n, (t, p) in zip(names, regressors)]).dropna("any")
    coef = fit_ols(rows, names)
    return coef, r_squared(predict(rows, coef, names))


def cross_lag_report(dense: DataFrame, specs: dict[str, Sequence[tuple[str, int]]], value: str = "value", head: int = 0) -> DataFrame:
    """(target, term, beta, r2) for several targets, from one scan of the panel whatever their number.

    One conditional aggregation by date lines up every series that any specification needs: the targets, their own and other tickers' lags
    and powers of these. A second one over the dates has the Gram terms of all specifications, each over the dates on which its own
    series are complete; a specification is then solved from its terms.
    """
    terms = list(dict.fromkeys(r for regs in specs.values() for r in regs))
    lagged = dense.withColumn("lag1", F.lag(value).over(by_ticker())).filter(F.col("pos") > head)
    pick = lambda ticker, c: F.max(F.when(F.col("ticker") == ticker, c))
    lined_up = lagged.groupBy("date").agg(*[pick(t, F.col(value)).alias(f"y{k}") for k, t in enumerate(specs)],
                                          *[pick(t, F.pow("lag1", F.lit(float(p)))).alias(f"x{k}") for k, (t, p) in enumerate(terms)])
    masked, grams = {}, []
    for k, (target, regs) in enumerate(specs.items()):
        own = [f"y{k}", *[f"x{terms.index(r)}" for r in regs]]
        complete = F.lit(True)
        for c in own:
            complete = complete & F.col(c).isNotNull()
        masked |= {f"s{k}_{i}": F.when(complete, F.col(c)) for i, c in enumerate(own)}
        names = [f"s{k}_{i + 1}" for i in range(len(regs))]
        grams += [t.alias(f"s{k}_{n}") for t, n in zip(gram_terms(names, f"s{k}_0"), gram_names(len(regs)))]
    one = stage(lined_up.select([c.alias(n) for n, c in masked.items()]).agg(*grams), "cross-lag-gram").table
    out = None
    for k, (target, regs) in enumerate(specs.items()):
        fit = solve_gram(one.select(*[F.col(f"s{k}_{n}").alias(n) for n in gram_names(len(regs))]), len(regs))
        part = coefficients_long(fit, [f"{t}^{p}" for t, p in regs], ["r2"]).withColumn("target", F.lit(target))
        out = part if out is None else out.unionByName(part)
    return out.select("target", "term", "beta", "r2")
