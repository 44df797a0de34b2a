"""Least squares from one aggregation.

The rows are reduced to a Gram matrix per group by merged co-moments (partial aggregation before the
shuffle); only the small matrices reach the solver, one row per fit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volarium.session import Staged, attach, stage


def gram_terms(xs: Sequence[str], y: str = "target") -> list[Column]:
    """Count, means, and upper-triangle co-moments of (features..., y) about the means.

    Spark merges the co-moments of partial aggregates about their own means, so a large common level of a column costs no digits.
    The terms read like sums of values less a pivot: g_p is the pivot, here the mean, g_s the sums less the pivot, here 0,
    and g_q the sums of products less the pivots.
    """
    cols = [*xs, y]
    terms = {"g_n": f"CAST(count(`{y}`) AS DOUBLE)"}
    terms |= {f"g_p{i}": f"avg(`{c}`)" for i, c in enumerate(cols)}
    terms |= {f"g_s{i}": "CAST(0 AS DOUBLE)" for i in range(len(cols))}
    terms |= {f"g_q{i}_{j}": f"covar_pop(`{cols[i]}`, `{cols[j]}`) * count(`{y}`)" for i in range(len(cols)) for j in range(i, len(cols))}
    return [F.expr(e).alias(n) for n, e in terms.items()]


def gram_names(k: int) -> list[str]:
    """Names of the terms for k features plus the target."""
    return ["g_n", *[f"g_p{i}" for i in range(k + 1)], *[f"g_s{i}" for i in range(k + 1)],
            *[f"g_q{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)]]


def additive_terms(grams: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Gram rows, few enough for one task (a row a date), moved to one common pivot, the mean of their means, so that they add up."""
    everything = Window.partitionBy(F.lit(1))
    rows = grams.where("g_n > 0").withColumns({f"p{i}": F.avg(f"g_p{i}").over(everything) for i in range(k + 1)})
    off = [F.col(f"g_p{i}") - F.col(f"p{i}") for i in range(k + 1)]
    return rows.select(*by, "g_n", *[F.col(f"p{i}").alias(f"g_p{i}") for i in range(k + 1)], *[(F.col(f"g_s{i}") + F.col("g_n") * off[i]).alias(f"g_s{i}") for i in range(k + 1)],
                       *[(F.col(f"g_q{i}_{j}") + F.col("g_n") * off[i] * off[j]).alias(f"g_q{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)])


def _solver(k: int):
    m = k + 1
    upper = np.triu_indices(m)

    @F.pandas_udf("struct<rank int, intercept double, beta array<double>, r2 double>")
    def solve(terms: pd.Series) -> pd.DataFrame:
        ranks, icpts, betas, shares = [], [], [], []
        for flat in terms:
            v = np.asarray(flat, dtype=float)
            n, pivot, s = v[0], v[1:m + 1], v[m + 1:2 * m + 1]
            q = np.zeros((m, m))
            q[upper] = v[2 * m + 1:]
            q = q + q.T - np.diag(np.diag(q))
            c = q - np.outer(s, s) / n  # centred products: the intercept drops out
            scale = np.sqrt(np.clip(np.diag(c)[:k], 0, None))
            scale[scale == 0] = 1.0
            a = c[:k, :k] / np.outer(scale, scale)
            # Minimum-norm solution in the original units when features are collinear.
            rank = int(np.linalg.matrix_rank(a, tol=1e-10, hermitian=True)) if k else 0
            if rank == k:
                beta = np.linalg.solve(a, c[:k, k] / scale) / scale
            else:
                beta = np.linalg.pinv(c[:k, :k], rcond=1e-10, hermitian=True) @ c[:k, k]
            ranks.append(rank)
            mean = pivot + s / n
            icpts.append(float(mean[k] - beta @ mean[:k]))
            betas.append(beta.tolist())
            left = c[k, k] - 2 * beta @ c[:k, k] + beta @ c[:k, :k] @ beta
            shares.append(float(1 - left / c[k, k]) if c[k, k] > 0 else float("nan"))
        return pd.DataFrame({"rank": ranks, "intercept": icpts, "beta": betas, "r2": shares})

    return solve


def solve_gram(grams: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, rank, intercept, beta, r2) from rows of Gram terms; r2 is the share of the target's variation in the sample explained."""
    fit = grams.filter("g_n > 0").select(*by, F.col("g_n").cast("long").alias("n"),
                                         _solver(k)(F.array(*gram_names(k))).alias("fit"))
    return fit.select(*by, "n", "fit.rank", "fit.intercept", "fit.beta", "fit.r2")


def fit_ols(train: DataFrame, xs: Sequence[str], y: str = "target", by: Sequence[str] = ()) -> Staged:
    """Ordinary least squares with intercept, one fit per `by` group (one fit overall without it)."""
    grams = train.groupBy(*by).agg(*gram_terms(xs, y))
    return stage(solve_gram(grams, len(xs), by), "ols")


def fit_nested(train: DataFrame, models: dict[str, Sequence[str]], y: str = "target", by: Sequence[str] = ()) -> Staged:
    """Several models over one table, reading it once: (by..., model, n, rank, intercept, beta).

    One Gram over the union of the features serves every model; a model's own Gram is a selection of
    its terms. `beta` follows the order of the model's features.
    """
    union = list(dict.fromkeys(x for xs in models.values() for x in xs))
    at = {c: i for i, c in enumerate([*union, y])}
    grams = stage(train.groupBy(*by).agg(*gram_terms(union, y)), "gram").table
    fits = None
    for model, xs in models.items():
        cols = [at[c] for c in (*xs, y)]
        picked = ["g_n", *[f"g_p{i}" for i in cols], *[f"g_s{i}" for i in cols],
                  *[f"g_q{min(i, j)}_{max(i, j)}" for k, i in enumerate(cols) for j in cols[k:]]]
        own = grams.selectExpr(*by, *[f"{t} AS {n}" for t, n in zip(picked, gram_names(len(xs)))])
        fit = solve_gram(own, len(xs), by).withColumn("model", F.lit(model))
        fits = fit if fits is None else fits.unionByName(fit)
    return stage(fits, "nested-ols")


def predict_nested(df: DataFrame, coef: Staged, models: dict[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """Forecasts of all models of `fit_nested` (single fit each) in one projection: (keep..., model, yhat)."""
    pick = lambda m, c: coef.table.filter(F.col("model") == m).select(c).scalar()
    coefs = [pick(m, c).alias(f"{c}{k}") for k, m in enumerate(models) for c in ("intercept", "beta")]
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), linear(xs, f"intercept{k}", f"beta{k}").alias("yhat"))
                      for k, (m, xs) in enumerate(models.items())])
    return df.select("*", *coefs).select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.model", "p.yhat")


def linear(xs: Sequence[str], intercept: str = "intercept", beta: str = "beta") -> Column:
    """Intercept plus the inner product with the features, unrolled so that it is code-generated."""
    return F.expr(" + ".join([intercept, *[f"{beta}[{i}] * `{x}`" for i, x in enumerate(xs)]]))


def predict(df: DataFrame, coef: Staged, xs: Sequence[str], by: Sequence[str] = (), name: str = "yhat") -> DataFrame:
    """Linear forecast; the coefficients of a single fit enter as scalars, of several fits by a join."""
    if by:
        joined = attach(df, Staged(coef.table.select(*by, "intercept", "beta"), coef.rows), list(by))
    else:
        joined = df.withColumns({c: coef.table.select(c).scalar() for c in ("intercept", "beta")})
    return joined.withColumn(name, linear(xs)).drop("intercept", "beta")


def coefficients_long(coef: DataFrame, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., term, beta) with the intercept as its own term."""
    terms = F.array(F.lit("intercept"), *[F.lit(x) for x in xs])
    values = F.concat(F.array("intercept"), F.col("beta"))
    return coef.select(*by, F.explode(F.arrays_zip(terms.alias("term"), values.alias("beta"))).alias("t")) \
        .select(*by, "t.term", "t.beta")


def fit_fixed_effects(train: DataFrame, xs: Sequence[str], y: str = "target", by: Sequence[str] = ()) -> tuple[Staged, Staged]:
    """Shared slopes with one intercept per ticker.

    The co-moments of a ticker are about its own means, so adding them up over the tickers is the within-ticker
    Gram; the rows are read once. Returns (slopes per by, intercepts per by and ticker).
    """
    by, k = list(by), len(xs)
    cols = [*xs, y]
    per_ticker = stage(train.groupBy(*by, "ticker").agg(*gram_terms(xs, y)), "ticker-gram")
    centred = [F.sum(f"g_q{i}_{j}").alias(f"g_q{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    grams = per_ticker.table.groupBy(*by).agg(
        F.sum("g_n").alias("g_n"), *[F.lit(0.0).alias(f"g_{c}{i}") for c in "ps" for i in range(k + 1)], *centred)
    slopes = stage(solve_gram(grams, k, by), "slopes")
    means = per_ticker.table.select(*by, "ticker", *[F.col(f"g_p{i}").alias(c) for i, c in enumerate(cols)])
    centred_fit = predict(means, slopes, xs, by, "level")
    return slopes, stage(centred_fit.select(*by, "ticker", (F.col(y) - F.col("level")).alias("alpha")), "alphas")


def r_squared(scored: DataFrame, by: Sequence[str] = (), y: str = "target", f: str = "yhat") -> DataFrame:
    """Coefficient of determination and squared correlation per group."""
    err = F.sum(F.pow(F.col(y) - F.col(f), F.lit(2.0)))
    return scored.groupBy(*by).agg(
        (1 - err / (F.var_pop(y) * F.count(y))).alias("r2"), F.pow(F.corr(y, f), F.lit(2.0)).alias("corr2"))
