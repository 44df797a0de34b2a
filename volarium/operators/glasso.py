"""Sparse inverse-covariance graphs with a cross-validated penalty, for many origins at once.

Moments of every (origin, fold) come from one blocked aggregation; returns never leave the executors.
Each penalised fit is an N x N problem and the fits fan out over (origin, fold). The search refines
the penalty grid around the best held-out likelihood, one job per refinement.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volarium.operators.graph import cross_moments
from volarium.session import Staged, attach, spread, stage

# Penalties per grid, grid refinements, contiguous folds, range of the first grid, penalty after a failure.
PENALTIES = 4
REFINEMENTS = 4
FOLDS = 5
GRID_RATIO = 0.01
FALLBACK = 0.01


def sparse_precision(cov: np.ndarray, penalty: float, start: tuple | None = None, tol: float = 1e-6,
                     max_iter: int = 3000) -> tuple[np.ndarray, tuple, bool]:
    """Minimise tr(S P) - log det P + penalty * sum |P_ij|, i <> j, by the alternating direction method.

    Zeros are exact because they come from soft-thresholding. Returns (precision, state, converged).
    """
    n = len(cov)
    unit = float(np.mean(np.diag(cov))) or 1.0  # solve at unit scale, undo at the end
    s, lam, rho = cov / unit, penalty / unit, 1.0
    z, u = start if start is not None else (np.diag(1.0 / np.maximum(np.diag(s), 1e-12)), np.zeros((n, n)))
    off, done = ~np.eye(n, dtype=bool), False
    for _ in range(max_iter):
        values, vectors = np.linalg.eigh(rho * (z - u) - s)
        theta = (vectors * ((values + np.sqrt(values ** 2 + 4 * rho)) / (2 * rho))) @ vectors.T
        old, z = z, theta + u
        z = np.where(off, np.sign(z) * np.maximum(np.abs(z) - lam / rho, 0.0), z)
        u = u + theta - z
        primal, dual = np.linalg.norm(theta - z), rho * np.linalg.norm(z - old)
        if max(primal, dual) <= tol * max(1.0, np.linalg.norm(z)):
            done = True
            break
        if primal > 10 * dual:
            rho, u = rho * 2, u / 2
        elif dual > 10 * primal:
            rho, u = rho / 2, u * 2
    return z / unit, (z, u * rho), done


def held_out_likelihood(test_cov: np.ndarray, precision: np.ndarray) -> float:
    sign, logdet = np.linalg.slogdet(precision)
    if sign <= 0:
        return float("-inf")
    return 0.5 * (logdet - np.sum(test_cov * precision) - len(precision) * np.log(2 * np.pi))


def _square(pdf: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    names = np.unique(pdf.src.to_numpy())
    i, j = np.searchsorted(names, pdf.src), np.searchsorted(names, pdf.dst)
    m = np.zeros((len(names), len(names)))
    m[i, j] = m[j, i] = pdf[column]
    return names, m


def fold_moments(returns: DataFrame, folds: int = FOLDS, value: str = "ret") -> Staged:
    """Pair sums per (origin, fold): the dates of an origin cut into contiguous folds of equal length.

    `returns` is complete: every (origin, date) has every ticker.
    """
    dates = returns.select("origin", "pos").distinct()
    order = Window.partitionBy("origin").orderBy("pos")
    whole = Window.partitionBy("origin")
    n = F.count(F.lit(1)).over(whole)
    i = F.row_number().over(order) - 1
    # The first n mod k folds are one date longer.
    size, extra = F.floor(n / folds), F.pmod(n, F.lit(folds))
    long = extra * (size + 1)
    fold = F.when(i < long, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - long) / size))
    numbered = stage(dates.select("origin", "pos", fold.cast("int").alias("fold")), "folds")
    return stage(cross_moments(attach(returns, numbered, ["origin", "pos"]), value, ["origin", "fold"]), "fold-moments")


def _cov(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    return sxy / n - (sx / n) * (sy / n)


def fold_covariances(moments: DataFrame) -> DataFrame:
    """Training (all other folds) and test covariance per (origin, fold, pair)."""
    w = Window.partitionBy("origin", "src", "dst")
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "sx", "sy", "sxy")}
    return moments.select(
        "origin", "fold", "src", "dst",
        _cov(*[rest[c] for c in ("n", "sx", "sy", "sxy")]).alias("train"),
        _cov(*[F.col(c) for c in ("n", "sx", "sy", "sxy")]).alias("test"))


def full_covariances(moments: DataFrame) -> DataFrame:
    total = moments.groupBy("origin", "src", "dst").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    return total.select("origin", "src", "dst", F.col("n").alias("n_dates"),
                        _cov(*[F.col(c) for c in ("n", "sx", "sy", "sxy")]).alias("cov"))


def _log_grid(high: Column, low: Column, n: int, inner: bool) -> Column:
    """n penalties from high to low, evenly spaced in logs; without the ends when `inner`."""
    steps = n + 1 if inner else n - 1
    first = 1 if inner else 0
    return F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)),
                       lambda k: F.exp(F.log(high) + (F.log(low) - F.log(high)) * k / steps))


def _score_fold(pdf: pd.DataFrame) -> pd.DataFrame:
    _, train = _square(pdf, "train")
    _, test = _square(pdf, "test")
    state, out = None, []
    for penalty in sorted(pdf.penalties.iloc[0], reverse=True):
        precision, state, _ = sparse_precision(train, penalty, state)
        out.append((int(pdf.origin.iloc[0]), int(pdf.fold.iloc[0]), float(penalty), held_out_likelihood(test, precision)))
    return pd.DataFrame(out, columns=["origin", "fold", "penalty", "likelihood"])


def search_penalty(moments: Staged, penalties: int = PENALTIES, refinements: int = REFINEMENTS) -> Staged:
    """(origin, penalty): highest mean held-out likelihood, the smaller penalty on ties."""
    covs = stage(fold_covariances(moments.table), "fold-cov")
    top = F.max(F.when(F.col("src") < F.col("dst"), F.abs("cov")))
    high = full_covariances(moments.table).groupBy("origin").agg(top.alias("high"))
    grid = stage(high.select("origin", _log_grid(F.col("high"), F.col("high") * GRID_RATIO, penalties, False)
                             .alias("penalties")), "penalties")
    origins = grid.rows
    tried, by = None, Window.partitionBy("origin").orderBy(F.col("penalty").desc())
    for _ in range(refinements):
        scored = spread(attach(covs.table, grid, ["origin"]), "origin", "fold").groupBy("origin", "fold").applyInPandas(
            _score_fold, "origin int, fold int, penalty double, likelihood double")
        means = scored.groupBy("origin", "penalty").agg(F.avg("likelihood").alias("likelihood"))
        tried = stage(means if tried is None else tried.table.unionByName(means), "scores")
        near = tried.table.select(
            "origin", "penalty", "likelihood",
            F.coalesce(F.lag("penalty").over(by), F.col("penalty")).alias("high"),
            F.coalesce(F.lead("penalty").over(by), F.col("penalty") * GRID_RATIO).alias("low"))
        best = near.groupBy("origin").agg(F.max_by(
            F.struct("penalty", "high", "low"), F.struct("likelihood", -F.col("penalty"))).alias("b"))
        # One row per origin, derived from the staged scores where it is needed.
        grid = Staged(best.select("origin", F.col("b.penalty").alias("penalty"),
                                  _log_grid(F.col("b.high"), F.col("b.low"), penalties, True).alias("penalties")), origins)
    return Staged(grid.table.select("origin", "penalty"), origins)


def _refit(weights: str, fallback: float, min_dates: int):
    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, cov = _square(pdf, "cov")
        origin, chosen = int(pdf.origin.iloc[0]), float(pdf.penalty.iloc[0])
        precision, used, status = np.eye(len(names)), chosen, "identity"
        if int(pdf.n_dates.iloc[0]) >= min_dates and np.isfinite(cov).all():
            for penalty, label in ((chosen, "ok"), (fallback, "fixed_penalty")):
                try:
                    found, _, converged = sparse_precision(cov, penalty)
                except np.linalg.LinAlgError:
                    continue
                if converged:
                    precision, used, status = found, penalty, label
                    break
        i, j = np.nonzero(precision)
        w = np.ones(len(i)) if weights == "binary" else np.abs(precision[i, j])
        return pd.DataFrame({"origin": origin, "src": names[i], "dst": names[j], "w": w,
                             "penalty": used, "status": status})
    return refit


def estimate_graph(returns: DataFrame, weights: str = "binary", penalty: float | None = None, fallback: float = FALLBACK,
                   folds: int = FOLDS, penalties: int = PENALTIES, refinements: int = REFINEMENTS,
                   min_dates: int = 2, value: str = "ret") -> Staged:
    """Edges (origin, src, dst, w, penalty, status) of the precision matrix's support, diagonal included.

    A fixed `penalty` skips the search. A fit that fails is repeated with the `fallback` penalty and
    falls back to the identity after that, as it does with fewer than `min_dates` dates; `status` tells which.
    """
    moments = fold_moments(returns, folds, value)
    full = full_covariances(moments.table)
    if penalty is None:
        with_penalty = attach(full, search_penalty(moments, penalties, refinements), ["origin"])
    else:
        with_penalty = full.withColumn("penalty", F.lit(float(penalty)))
    schema = "origin int, src string, dst string, w double, penalty double, status string"
    fits = spread(with_penalty, "origin").groupBy("origin").applyInPandas(_refit(weights, fallback, min_dates), schema)
    return stage(fits, "glasso-edges")


def sample_warning(returns: DataFrame, n_tickers: int, factor: float = 2.0) -> DataFrame:
    """Origins whose window is short for the number of pairs (T < factor * N^2)."""
    n = returns.groupBy("origin").agg(F.countDistinct("pos").alias("n_dates"))
    return n.withColumn("short", F.col("n_dates") < F.lit(factor * n_tickers ** 2))


def origin_returns(returns: DataFrame, origins: DataFrame, columns: Sequence[str] = ("ret",)) -> DataFrame:
    """Returns of [s, o) for each origin, tickers without any return in the window left out."""
    spans = origins.select("origin", F.explode(F.sequence("s_pos", F.col("o_pos") - 1)).alias("pos"))
    rows = returns.select("pos", "date", "ticker", *columns).join(spans, "pos")
    known = rows.groupBy("origin", "ticker").agg(F.count(columns[0]).alias("n")).filter("n > 0")
    return rows.join(known.select("origin", "ticker"), ["origin", "ticker"], "left_semi")
