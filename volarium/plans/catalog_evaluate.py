"""Queries: scoring, ranking, regimes, comparisons and the confidence set."""

from __future__ import annotations

from pyspark.sql import functions as F

from volarium.functions.scalars import rounded
from volarium.operators import evaluate, har, mcs
from volarium.plans import sqlkit as q
from volarium.plans import tables as t
from volarium.plans.registry import query
from volarium.session import stage

PRED = f"{q.SUPPLIER_DENSE}, {q.features('nested')}, {q.LAG_FORECASTS}"
NPRED = f"{q.nation_dense()}, {q.features('nested')}, {q.LAG_FORECASTS}"
LOSSES = f"losses AS (SELECT model, ticker, {q.MSE} AS mse, {q.QLIKE} AS qlike FROM pred GROUP BY 1, 2)"
DATE = "CAST(date AS VARCHAR) AS date"


def predictions(spark, sf):
    return t.lag_forecasts(t.supplier_features(spark, sf).table)


def nation_predictions(spark, sf):
    return t.lag_forecasts(t.nation_features(spark, sf).table)


def _round(df, keys, values, digits=6):
    return df.select(*keys, *[rounded(v, digits).alias(v) for v in values])


@query("A7 A5 A6", f"WITH {PRED}, {LOSSES} SELECT model, ticker, round(mse, 6) + 0.0 AS mse, round(qlike, 6) + 0.0 AS qlike FROM losses")
def loss_table(spark, sf):
    return _round(evaluate.loss_table(predictions(spark, sf)), ["model", "ticker"], ["mse", "qlike"])


@query("A5", f"""WITH {PRED}
SELECT model, round({q.MSE}, 6) + 0.0 AS mse, round(sqrt({q.MSE}), 6) + 0.0 AS rmse, round(avg(abs(target - yhat)), 6) + 0.0 AS mae, count(*) AS n_samples
FROM pred GROUP BY 1""")
def error_metrics(spark, sf):
    return _round(evaluate.error_metrics(predictions(spark, sf)), ["model", "n_samples"], ["mse", "rmse", "mae"])


QLIKE_MODES = {"plain": {}, "floor_pred": {"eps_pred": 1e-8}, "floor_both": {"eps_pred": 1e-8, "eps_true": 1e-8},
               "add_both": {"eps_pred": 1e-4, "eps_true": 1e-4, "mode": "add"}, "floor_pred_wide": {"eps_pred": 1e-6},
               "floor_both_wide": {"eps_pred": 1e-4, "eps_true": 1e-4}}


@query("A6", f"WITH {PRED} SELECT model, " + ", ".join(
    f"round(avg({q.qlike(**kw)}), 6) + 0.0 AS {n}" for n, kw in QLIKE_MODES.items()) + " FROM pred GROUP BY 1")
def qlike_modes(spark, sf):
    from volarium.functions.scalars import qlike_term

    return predictions(spark, sf).groupBy("model").agg(*[
        rounded(F.avg(qlike_term("target", "yhat", **kw)), 6).alias(n) for n, kw in QLIKE_MODES.items()])


@query("J5", f"""WITH {NPRED} SELECT model, count(*) AS n, round({q.MSE}, 6) + 0.0 AS mse FROM pred GROUP BY 1""")
def truth_lookup(spark, sf):
    feats = t.nation_features(spark, sf).table
    pred = t.lag_forecasts(feats).select("model", "date", "ticker", "yhat")
    truth = feats.select("date", "ticker", "target")
    return evaluate.align_truth(pred, truth).groupBy("model").agg(
        F.count("target").alias("n"), rounded(evaluate.loss_columns()["mse"], 6).alias("mse"))


@query("A9 A7", f"""WITH {PRED}, {LOSSES}, rounded AS (SELECT model, ticker, round(mse, 4) AS mse, round(qlike, 4) AS qlike FROM losses),
means AS (SELECT model, avg(mse) AS mse, avg(qlike) AS qlike FROM rounded GROUP BY 1)
SELECT model, round(mse, 8) + 0.0 AS mse, round(qlike, 8) + 0.0 AS qlike,
  round(mse / (SELECT mse FROM means WHERE model = 'DAY'), 6) + 0.0 AS mse_ratio,
  round(qlike / (SELECT qlike FROM means WHERE model = 'DAY'), 6) + 0.0 AS qlike_ratio FROM means""")
def mean_losses(spark, sf):
    losses = evaluate.loss_table(predictions(spark, sf), round_losses=4)
    table = evaluate.ratio_to_baseline(evaluate.mean_losses(losses), "DAY")
    out = _round(table, ["model", "mse_ratio", "qlike_ratio"], ["mse", "qlike"], 8)
    return _round(out, ["model", "mse", "qlike"], ["mse_ratio", "qlike_ratio"])


@query("A9", f"""WITH {PRED}, {LOSSES}
SELECT a.model, a.ticker, round(a.mse / b.mse, 6) + 0.0 AS mse_ratio, round(a.qlike / b.qlike, 6) + 0.0 AS qlike_ratio
FROM losses a JOIN losses b ON a.ticker = b.ticker AND b.model = 'DAY'""")
def loss_ratio_by_ticker(spark, sf):
    table = evaluate.ratio_to_baseline(evaluate.loss_table(predictions(spark, sf)), "DAY", by=["ticker"])
    return _round(table, ["model", "ticker"], ["mse_ratio", "qlike_ratio"])


@query("A10 P16", f"""WITH {PRED}, s AS (SELECT model, {q.MSE} AS mse, {q.QLIKE} AS qlike FROM pred GROUP BY 1)
SELECT model, round((first_value(mse) OVER (ORDER BY mse DESC) - mse) / first_value(mse) OVER (ORDER BY mse DESC) * 100, 5) + 0.0 AS mse_improvement,
  round((first_value(qlike) OVER (ORDER BY qlike DESC) - qlike) / first_value(qlike) OVER (ORDER BY qlike DESC) * 100, 5) + 0.0 AS qlike_improvement
FROM s QUALIFY contains(model, 'K') OR contains(model, 'TH')""")
def improvement_over_worst(spark, sf):
    table = evaluate.improvement(evaluate.loss_table(predictions(spark, sf), ["model"]), "worst")
    kept = table.filter(F.col("model").contains("K") | F.col("model").contains("TH"))
    return _round(kept, ["model"], ["mse_improvement", "qlike_improvement"], 5)


@query("A13", f"""WITH {PRED}, {LOSSES}
SELECT model, count(mse) AS n, round(avg(mse), 6) + 0.0 AS mean, round(stddev_samp(mse), 6) + 0.0 AS std, round(min(mse), 6) + 0.0 AS min,
  round(quantile_cont(mse, 0.25), 6) + 0.0 AS q25, round(median(mse), 6) + 0.0 AS median, round(quantile_cont(mse, 0.75), 6) + 0.0 AS q75, round(max(mse), 6) + 0.0 AS max
FROM losses GROUP BY 1""")
def describe_losses(spark, sf):
    d = evaluate.describe(evaluate.loss_table(predictions(spark, sf)), "mse", ["model"])
    return _round(d, ["model", "n"], ["mean", "std", "min", "q25", "median", "q75", "max"])


@query("A14", f"""WITH {PRED}, {LOSSES}
SELECT ticker, arg_min(model, mse) AS lowest, round(min(mse), 6) + 0.0 AS lowest_value, arg_max(model, mse) AS highest, round(max(mse), 6) + 0.0 AS highest_value
FROM losses GROUP BY 1""")
def best_model_by_ticker(spark, sf):
    e = evaluate.extreme_rows(evaluate.loss_table(predictions(spark, sf)), "mse", by=["ticker"])
    return _round(e, ["ticker", "lowest", "highest"], ["lowest_value", "highest_value"])


@query("P15 A7", f"""WITH {PRED} SELECT model, round({q.MSE}, 6) + 0.0 AS mse, round({q.QLIKE}, 6) + 0.0 AS qlike, count(*) AS n FROM pred GROUP BY 1""")
def asserted_forecast_losses(spark, sf):
    """Losses of forecasts that are asserted to be positive in the job that scores them: one that is not stops the job."""
    checked = evaluate.assert_positive(predictions(spark, sf))
    cols = evaluate.loss_columns()
    out = checked.groupBy("model").agg(cols["mse"].alias("mse"), cols["qlike"].alias("qlike"), F.count("yhat").alias("n"))
    return _round(out, ["model", "n"], ["mse", "qlike"])


REGIMES = """market AS (SELECT date, sum(value) AS value FROM dense GROUP BY 1),
scored AS (SELECT * FROM market WHERE date IN (SELECT date FROM pred)),
regimes AS (SELECT date, CASE WHEN value >= (SELECT quantile_cont(value, 0.9) FROM scored) THEN 'high' ELSE 'low' END AS regime FROM scored)"""


def market_and_predictions(spark, sf, dense_panel=t.dense_suppliers):
    """Forecasts and the market series of one panel that is built once."""
    dense = stage(dense_panel(spark, sf), "dense").table
    pred = t.lag_forecasts(stage(har.har_panel(dense), "features").table)
    return pred, evaluate.label_regimes(dense.groupBy("date").agg(F.sum("value").alias("value")), pred)


@query("J11 A4", f"WITH {PRED}, {REGIMES} SELECT {DATE}, regime FROM regimes")
def regime_labels(spark, sf):
    return market_and_predictions(spark, sf)[1].table.select(t.text_date(), "regime")


@query("A8 J11", f"""WITH {PRED}, {REGIMES}
SELECT model, regime, ticker, round({q.MSE}, 6) + 0.0 AS mse, round({q.QLIKE}, 6) + 0.0 AS qlike FROM pred JOIN regimes USING (date) GROUP BY 1, 2, 3""")
def regime_losses(spark, sf):
    return _round(evaluate.regime_losses(*market_and_predictions(spark, sf)), ["model", "regime", "ticker"], ["mse", "qlike"])


@query("A17", f"""WITH {PRED}, e AS (SELECT model, 'error' AS kind, yhat - target AS v FROM pred UNION ALL SELECT model, 'ratio', yhat / target FROM pred)
SELECT model, kind, round(quantile_cont(v, 0.25), 6) + 0.0 AS q25, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(quantile_cont(v, 0.75), 6) + 0.0 AS q75 FROM e GROUP BY 1, 2""")
def error_quartiles(spark, sf):
    return _round(evaluate.error_quartiles(predictions(spark, sf)), ["model", "kind"], ["q25", "median", "q75"])


@query("A18", f"""WITH {PRED}
SELECT model, ticker, round(avg(target - yhat), 6) + 0.0 AS residual_mean, round(stddev_pop(target - yhat), 6) + 0.0 AS residual_std,
  round(pow(corr(target, yhat), 2), 6) + 0.0 AS corr2, round(1 - sum(pow(target - yhat, 2)) / (var_pop(target) * count(*)), 6) + 0.0 AS r2
FROM pred GROUP BY 1, 2""")
def residual_statistics(spark, sf):
    return _round(evaluate.residual_stats(predictions(spark, sf)), ["model", "ticker"], ["residual_mean", "residual_std", "corr2", "r2"])


@query("A19 O1", f"""WITH {PRED}
SELECT ticker, round({q.MSE}, 6) + 0.0 AS mse, round({q.QLIKE}, 6) + 0.0 AS qlike, round(avg(target), 6) + 0.0 AS mean_level FROM pred WHERE model = 'WEEK' GROUP BY 1""")
def ticker_leaderboard(spark, sf):
    return _round(evaluate.ticker_leaderboard(predictions(spark, sf).filter("model = 'WEEK'")), ["ticker"], ["mse", "qlike", "mean_level"]).orderBy("mse")


@query("O2 O3", f"""WITH {PRED}, s AS (SELECT ticker, {q.MSE} AS mse FROM pred WHERE model = 'WEEK' GROUP BY 1)
SELECT * FROM (SELECT ticker, round(mse, 6) + 0.0 AS mse, 'best' AS side FROM s ORDER BY s.mse, ticker LIMIT 5)
UNION ALL SELECT * FROM (SELECT ticker, round(mse, 6) + 0.0, 'worst' FROM s ORDER BY s.mse DESC, ticker LIMIT 5)""")
def best_and_worst(spark, sf):
    table = stage(evaluate.loss_table(predictions(spark, sf).filter("model = 'WEEK'"), ["ticker"]), "losses").table
    return _round(evaluate.best_and_worst(table, "mse"), ["ticker", "side"], ["mse"])


@query("A20", f"""WITH {PRED}, {LOSSES}, r AS (SELECT model, r_name AS region, l.mse, l.qlike FROM losses l
  JOIN supplier ON CAST(s_suppkey AS VARCHAR) = l.ticker JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT region, avg(mse) AS mse, avg(qlike) AS qlike FROM r GROUP BY 1)
SELECT region, round(mse, 6) + 0.0 AS mse, round(qlike, 6) + 0.0 AS qlike, round((mse / min(mse) OVER () - 1) * 100, 5) + 0.0 AS mse_gap,
  round((qlike / min(qlike) OVER () - 1) * 100, 5) + 0.0 AS qlike_gap FROM g""")
def group_gaps(spark, sf):
    s = t.read(spark, sf, "supplier").join(t.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")) \
        .join(t.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("region"))
    gaps = evaluate.group_gaps(evaluate.loss_table(predictions(spark, sf)).join(s, "ticker"), "region")
    out = _round(gaps, ["region", "mse_gap", "qlike_gap"], ["mse", "qlike"])
    return _round(out, ["region", "mse", "qlike"], ["mse_gap", "qlike_gap"], 5)


@query("W11 T23", f"""WITH {PRED}, {LOSSES}, r AS (SELECT model, ticker, round(mse, 1) AS mse1 FROM losses)
SELECT model, ticker, round(rank() OVER (PARTITION BY model ORDER BY mse1) + (count(*) OVER (PARTITION BY model, mse1) - 1) / 2.0, 3) + 0.0 AS avg_rank FROM r""")
def average_ranks(spark, sf):
    losses = evaluate.loss_table(predictions(spark, sf), round_losses=1)
    return evaluate.average_rank(losses, "mse", "avg_rank", ["model"]).select("model", "ticker", "avg_rank")


@query("W13 M13", f"""WITH {NPRED}, steps AS (SELECT ticker, model, pos, round(abs(target - yhat), 1) AS valid FROM pred),
d AS (SELECT *, abs(valid - lag(valid) OVER (PARTITION BY ticker, model ORDER BY pos)) AS step FROM steps)
SELECT ticker, model, round(avg(CASE WHEN step < 1e-6 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS flat_share, arg_max(valid, pos) + 0.0 AS final_loss FROM d GROUP BY 1, 2""")
def plateau_share(spark, sf):
    steps = nation_predictions(spark, sf).select("ticker", "model", "pos", F.round(F.abs(F.col("target") - F.col("yhat")), 1).alias("valid"))
    return _round(evaluate.flat_share(steps, ["ticker", "model"], "pos"), ["ticker", "model", "final_loss"], ["flat_share"])


@query("A21 M14", f"""WITH {NPRED}, seeds AS (SELECT model, ticker, {q.MSE} AS valid_loss FROM pred GROUP BY 1, 2),
kept AS (SELECT model, ticker FROM (SELECT *, quantile_cont(valid_loss, 0.5) OVER (PARTITION BY model) AS threshold FROM seeds) WHERE valid_loss <= threshold)
SELECT model, CAST(date AS VARCHAR) AS date, round(avg(yhat), 9) + 0.0 AS yhat, count(*) AS n FROM pred JOIN kept USING (model, ticker) GROUP BY 1, 2""")
def ensemble_screen(spark, sf):
    """Members of an ensemble (here the assets' forecasts) kept below the median loss, then averaged."""
    pred = nation_predictions(spark, sf)
    losses = evaluate.loss_table(pred).withColumnRenamed("mse", "valid_loss")
    kept = evaluate.screen_ensemble(losses, ["model"]).select("model", "ticker")
    members = pred.join(kept, ["model", "ticker"], "left_semi")
    n = members.groupBy("model", "date").agg(F.count(F.lit(1)).alias("n"))
    out = evaluate.ensemble_mean(members, ["model", "date"]).join(n, ["model", "date"])
    return out.select("model", t.text_date(), rounded("yhat").alias("yhat"), "n")


MODELS = ("DAY", "MONTH", "WEEK")


def mcs_sql(unit: str, metric: str, n_boot: int, block: int, algorithm: str, alpha: float = 0.05, seed: int = 0) -> str:
    """Confidence set of three models in two unrolled rounds."""
    loss = "avg((target - yhat) * (target - yhat))" if metric == "mse" else q.QLIKE
    z = "abs((dstar - dbar) / sqrt(v))" if algorithm == "R" else "pow((dstar - dbar) / sqrt(v), 2)"
    agg = "max(z)" if algorithm == "R" else "sum(z) / 2"
    obs = "max(dbar / sqrt(v))" if algorithm == "R" else "sum(pow(dbar / sqrt(v), 2)) / 2"

    def round_(k):
        alive = f"(SELECT model FROM alive{k})"
        return f"""stat{k} AS (SELECT b, {agg} AS s FROM (SELECT b, {z} AS z FROM dstar JOIN dij USING (i, j)
  WHERE i IN {alive} AND j IN {alive}) GROUP BY 1),
obs{k} AS (SELECT {obs} AS s FROM dij WHERE i IN {alive} AND j IN {alive}),
p{k} AS (SELECT avg(CASE WHEN stat{k}.s > obs{k}.s THEN 1.0 ELSE 0.0 END) AS p FROM stat{k}, obs{k}),
mean{k} AS (SELECT j, sum(dbar) / (count(*)) AS m FROM dij WHERE i IN {alive} AND j IN {alive} GROUP BY 1),
t{k} AS (SELECT j, any_value(m) / sqrt(avg(pow(ms - m, 2))) AS t FROM
  (SELECT b, j, sum(dstar) / count(*) AS ms FROM dstar WHERE i IN {alive} AND j IN {alive} GROUP BY 1, 2) JOIN mean{k} USING (j) GROUP BY 1),
out{k} AS (SELECT arg_max(j, t) AS model FROM t{k}),
alive{k + 1} AS (SELECT model FROM alive{k} WHERE model NOT IN (SELECT model FROM out{k}))"""

    return f"""loss AS (SELECT model, {unit} AS unit, {loss} AS l FROM pred GROUP BY 1, 2),
units AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS pos, count(*) OVER () AS t FROM (SELECT DISTINCT unit FROM loss)),
draw0 AS (SELECT b, pos, t, CASE WHEN pos = 0 OR {q.uniform(f"'r{seed}'", 'b', 'pos')} < {1 / block!r}
    THEN floor({q.uniform(f"'s{seed}'", 'b', 'pos')} * t) - pos END AS start
  FROM units, (SELECT unnest(range({n_boot})) AS b)),
draws AS (SELECT b, pos, CAST((((last_value(start IGNORE NULLS) OVER (PARTITION BY b ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    + pos) % t) + t) % t AS BIGINT) AS idx FROM draw0),
boot AS (SELECT b, model, avg(l) AS l FROM draws JOIN units u ON u.pos = draws.idx JOIN loss USING (unit) GROUP BY 1, 2),
means AS (SELECT model, avg(l) AS l FROM loss GROUP BY 1),
dstar AS (SELECT x.b, x.model AS i, y.model AS j, y.l - x.l AS dstar FROM boot x JOIN boot y ON x.b = y.b AND x.model <> y.model),
dij AS (SELECT x.model AS i, y.model AS j, y.l - x.l AS dbar, v FROM means x JOIN means y ON x.model <> y.model
  JOIN (SELECT i, j, avg(pow(dstar - (SELECT l FROM means WHERE model = j) + (SELECT l FROM means WHERE model = i), 2)) AS v FROM dstar GROUP BY 1, 2) s
    ON s.i = x.model AND s.j = y.model),
alive0 AS (SELECT DISTINCT model FROM loss),
{round_(0)},
{round_(1)},
steps AS (SELECT model, 0 AS step, p AS raw FROM out0, p0 UNION ALL SELECT model, 1, p FROM out1, p1 UNION ALL SELECT model, 2, 1.0 FROM alive2),
mcs AS (SELECT model, step, max(raw) OVER (ORDER BY step) AS p_value FROM steps)"""


def _mcs_query(unit, metric, n_boot, block, algorithm):
    return f"""WITH {NPRED}, {mcs_sql(unit, metric, n_boot, block, algorithm)}
SELECT model, step, round(p_value, 6) + 0.0 AS p_value, p_value > 0.05 AS included FROM mcs"""


RESAMPLES = 10_000  # as the reference, here and in the SQL


def unit_losses(spark, sf, unit, nations=True):
    pred = nation_predictions(spark, sf) if nations else predictions(spark, sf)
    return evaluate.loss_table(pred, ["model", unit])


def _set(df):
    return df.select("model", "step", rounded("p_value", 6).alias("p_value"), "included")


@query("M20 M17 M18 M19 J12 W12 W15 U3", _mcs_query("ticker", "mse", RESAMPLES, 2, "SQ"))
def confidence_set_by_ticker(spark, sf):
    return _set(mcs.confidence_set(unit_losses(spark, sf, "ticker"), "ticker", MODELS, "mse", n_boot=RESAMPLES))


@query("M20 M19 T16", _mcs_query("date", "qlike", RESAMPLES, 5, "R"))
def confidence_set_by_date(spark, sf):
    return _set(mcs.confidence_set(unit_losses(spark, sf, "date"), "date", MODELS, "qlike", n_boot=RESAMPLES, block=5, algorithm="R"))


@query("M17 W15", f"""WITH {PRED}, units AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS pos, count(*) OVER () AS t FROM (SELECT DISTINCT ticker FROM pred)),
draw0 AS (SELECT b, pos, t, CASE WHEN pos = 0 OR {q.uniform("'r7'", 'b', 'pos')} < {1 / 4!r} THEN floor({q.uniform("'s7'", 'b', 'pos')} * t) - pos END AS start
  FROM units, (SELECT unnest(range({RESAMPLES})) AS b))
SELECT b, pos, CAST((((last_value(start IGNORE NULLS) OVER (PARTITION BY b ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + pos) % t) + t) % t AS BIGINT) AS idx FROM draw0""")
def block_bootstrap(spark, sf):
    matrix = mcs.loss_matrix(unit_losses(spark, sf, "ticker", nations=False), "ticker", MODELS, "mse")
    return mcs.bootstrap_draws(matrix, RESAMPLES, 4, seed=7).select(*[F.col(c).cast("long").alias(c) for c in ("b", "pos", "idx")])


@query("M18 J12", f"""WITH {NPRED}, {mcs_sql('ticker', 'mse', RESAMPLES, 2, 'SQ')}
SELECT i, j, round(dbar, 6) + 0.0 AS dbar, round(v * 1000, 6) + 0.0 AS variance FROM dij""")
def loss_difference_moments(spark, sf):
    pairs = mcs.difference_moments(unit_losses(spark, sf, "ticker"), [], "ticker", MODELS, "mse", RESAMPLES, 2)
    return _round(pairs.withColumn("variance", F.col("variance") * 1000), ["i", "j"], ["dbar", "variance"])


@query("M21 A9 W11", f"""WITH {NPRED}, {mcs_sql('ticker', 'mse', RESAMPLES, 2, 'SQ')},
m AS (SELECT model, avg(l) AS loss FROM loss GROUP BY 1)
SELECT model, round(m.loss, 6) + 0.0 AS loss, round(m.loss / (SELECT loss FROM m WHERE model = 'DAY'), 6) + 0.0 AS loss_ratio,
  CAST(rank() OVER (ORDER BY m.loss) AS DOUBLE) AS rank, round(p_value, 6) + 0.0 AS p_value, p_value > 0.05 AS included FROM m JOIN mcs USING (model)""")
def confidence_report(spark, sf):
    report = mcs.mcs_report(stage(unit_losses(spark, sf, "ticker"), "losses").table, "ticker", MODELS, "DAY", "mse", n_boot=RESAMPLES)
    return _round(report, ["model", "rank", "included"], ["loss", "loss_ratio", "p_value"])


def keyed_mcs_sql(n_boot: int, block: int, alpha: float = 0.05, seed: int = 0) -> str:
    """Confidence sets (SQ) of three models for every set g of loss(g, model, unit, l), in two unrolled rounds."""
    def round_(k):
        pairs = f"JOIN alive{k} a ON a.g = d.g AND a.model = d.i JOIN alive{k} c ON c.g = d.g AND c.model = d.j"
        return f"""stat{k} AS (SELECT d.g, b, sum(pow((dstar - dbar) / sqrt(v), 2)) / 2 AS s FROM dstar s JOIN dij d ON s.g = d.g AND s.i = d.i AND s.j = d.j {pairs} GROUP BY ALL),
obs{k} AS (SELECT d.g, sum(pow(dbar / sqrt(v), 2)) / 2 AS s FROM dij d {pairs} GROUP BY 1),
p{k} AS (SELECT g, avg(CASE WHEN x.s > o.s THEN 1.0 ELSE 0.0 END) AS p FROM stat{k} x JOIN obs{k} o USING (g) GROUP BY 1),
mean{k} AS (SELECT d.g, j, avg(dbar) AS m FROM dij d {pairs} GROUP BY ALL),
t{k} AS (SELECT x.g, x.j, any_value(m) / sqrt(avg(pow(ms - m, 2))) AS t FROM (SELECT d.g, b, j, avg(dstar) AS ms FROM dstar d {pairs} GROUP BY ALL) x JOIN mean{k} USING (g, j) GROUP BY ALL),
out{k} AS (SELECT g, arg_max(j, t) AS model FROM t{k} GROUP BY 1),
alive{k + 1} AS (SELECT g, model FROM alive{k} EXCEPT SELECT g, model FROM out{k})"""

    return f"""units AS (SELECT g, unit, row_number() OVER (PARTITION BY g ORDER BY unit) - 1 AS pos, count(*) OVER (PARTITION BY g) AS t FROM (SELECT DISTINCT g, unit FROM loss)),
draw0 AS (SELECT g, b, pos, t, CASE WHEN pos = 0 OR {q.uniform(f"'r{seed}'", 'b', 'pos')} < {1 / block!r} THEN floor({q.uniform(f"'s{seed}'", 'b', 'pos')} * t) - pos END AS start
  FROM units, (SELECT unnest(range({n_boot})) AS b)),
draws AS (SELECT g, b, CAST((((last_value(start IGNORE NULLS) OVER (PARTITION BY g, b ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + pos) % t) + t) % t AS BIGINT) AS idx FROM draw0),
boot AS (SELECT d.g, b, model, avg(l) AS l FROM draws d JOIN units u ON u.g = d.g AND u.pos = d.idx JOIN loss x ON x.g = u.g AND x.unit = u.unit GROUP BY ALL),
means AS (SELECT g, model, avg(l) AS l FROM loss GROUP BY ALL),
dstar AS (SELECT x.g, x.b, x.model AS i, y.model AS j, y.l - x.l AS dstar FROM boot x JOIN boot y ON x.g = y.g AND x.b = y.b AND x.model <> y.model),
dbars AS (SELECT x.g, x.model AS i, y.model AS j, y.l - x.l AS dbar FROM means x JOIN means y ON x.g = y.g AND x.model <> y.model),
dij AS (SELECT m.g, m.i, m.j, any_value(dbar) AS dbar, avg(pow(dstar - dbar, 2)) AS v FROM dstar s JOIN dbars m ON s.g = m.g AND s.i = m.i AND s.j = m.j GROUP BY ALL),
alive0 AS (SELECT DISTINCT g, model FROM loss),
{round_(0)},
{round_(1)},
steps AS (SELECT g, model, 0 AS step, p AS raw FROM out0 JOIN p0 USING (g) UNION ALL SELECT g, model, 1, p FROM out1 JOIN p1 USING (g) UNION ALL SELECT g, model, 2, 1.0 FROM alive2),
mcs AS (SELECT g, model, step, max(raw) OVER (PARTITION BY g ORDER BY step) AS p_value FROM steps)"""


REPORT_ORDER = ("DAY", "WEEK", "MONTH")


@query("M21 A8 J11 M20", f"""WITH {NPRED}, {REGIMES},
l0 AS (SELECT model, regime, ticker, round({q.MSE}, 4) AS mse, round({q.QLIKE}, 4) AS qlike FROM pred JOIN regimes USING (date) GROUP BY 1, 2, 3),
loss AS (SELECT regime || ' mse' AS g, model, ticker AS unit, mse AS l FROM l0 UNION ALL SELECT regime || ' qlike', model, ticker, qlike FROM l0),
{keyed_mcs_sql(RESAMPLES, 2)},
base AS (SELECT g, l FROM means WHERE model = 'DAY')
SELECT split_part(g, ' ', 1) AS regime, split_part(g, ' ', 2) AS metric, m.model, CAST(list_position(['DAY', 'WEEK', 'MONTH'], m.model) AS INT) AS place, round(m.l, 6) + 0.0 AS loss,
  round(m.l / base.l, 3) + 0.0 AS loss_ratio, CAST(rank() OVER (PARTITION BY g ORDER BY m.l) AS DOUBLE) AS rank, round(p_value, 3) + 0.0 AS p_value, p_value > 0.05 AS included
FROM means m JOIN mcs USING (g, model) JOIN base USING (g)""")
def confidence_report_by_regime(spark, sf):
    """The printed reports of both metrics in both regimes: losses rounded to 4 digits first, models in the given order, figures to 3 digits."""
    losses = stage(evaluate.regime_losses(*market_and_predictions(spark, sf, t.dense_nations), round_losses=4), "losses").table
    long = losses.unpivot(["regime", "ticker", "model"], ["mse", "qlike"], "metric", "value")
    report = mcs.confidence_reports(long, ["regime", "metric"], "ticker", MODELS, "DAY", "value", shown=REPORT_ORDER, n_boot=RESAMPLES)
    out = _round(report, ["regime", "metric", "model", "place", "rank", "included", "loss_ratio", "p_value"], ["loss"])
    return _round(out, ["regime", "metric", "model", "place", "loss", "rank", "included"], ["loss_ratio", "p_value"], 3).orderBy("regime", "metric", "place")
