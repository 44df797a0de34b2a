"""Loss tables, rankings, regimes and comparisons over long forecasts (model, date, ticker, target, yhat)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volarium.functions.scalars import qlike_term, ratio, squared_error
from volarium.operators.intraday import exact_percentiles
from volarium.session import Staged, attach, stage


def align_truth(pred: DataFrame, truth: DataFrame, on: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Truth looked up for every forecast; a forecast without truth is an error, not a dropped row."""
    joined = pred.join(truth, list(on), "left")
    return joined.withColumn("target", F.when(F.col("target").isNotNull(), F.col("target")).otherwise(
        F.raise_error(F.concat(F.lit("no truth for "), F.concat_ws(", ", *on))).cast("double")))


def assert_positive(pred: DataFrame, yhat: str = "yhat") -> DataFrame:
    """Fails the job on a forecast that is not positive."""
    return pred.withColumn(yhat, F.when(F.col(yhat) > 0, F.col(yhat)).otherwise(
        F.raise_error(F.lit("forecast is not positive")).cast("double")))


def count_nonpositive(pred: DataFrame, by: Sequence[str], yhat: str = "yhat") -> DataFrame:
    return pred.groupBy(*by).agg(F.count(F.when(F.col(yhat) <= 0, 1)).alias("n_bad"), F.count(F.lit(1)).alias("n"))


def loss_columns(y: str = "target", f: str = "yhat", **qlike) -> dict[str, Column]:
    return {"mse": F.avg(squared_error(y, f)), "qlike": F.avg(qlike_term(y, f, **qlike))}


def loss_table(pred: DataFrame, by: Sequence[str] = ("model", "ticker"), round_losses: int | None = None,
               **qlike) -> DataFrame:
    """MSE and QLIKE per group in one pass; optionally rounded before anything is averaged over them."""
    out = pred.groupBy(*by).agg(*[c.alias(n) for n, c in loss_columns(**qlike).items()])
    if round_losses is not None:
        out = out.withColumns({n: F.round(n, round_losses) for n in ("mse", "qlike")})
    return out


def error_metrics(pred: DataFrame, by: Sequence[str] = ("model",), y: str = "target", f: str = "yhat") -> DataFrame:
    """MSE, RMSE, MAE and the number of scored cells (cells with truth and forecast)."""
    both = F.col(y).isNotNull() & F.col(f).isNotNull()
    mse = F.avg(squared_error(y, f))
    return pred.groupBy(*by).agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(F.col(y) - F.col(f))).alias("mae"),
        F.count(F.when(both, 1)).alias("n_samples"))


def mean_losses(losses: DataFrame, metrics: Sequence[str] = ("mse", "qlike"), by: Sequence[str] = ("model",)) -> DataFrame:
    """Average of the per-ticker losses."""
    return losses.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def ratio_to_baseline(table: DataFrame, baseline: str, metrics: Sequence[str] = ("mse", "qlike"),
                      by: Sequence[str] = ()) -> DataFrame:
    """Each metric divided by the baseline model's, within `by` (or over the whole table)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    base = {m: F.max(F.when(F.col("model") == baseline, F.col(m))).over(w) for m in metrics}
    return table.withColumns({f"{m}_ratio": F.col(m) / b for m, b in base.items()})


def improvement(table: DataFrame, baseline: str, metrics: Sequence[str] = ("mse", "qlike")) -> DataFrame:
    """Percent reduction of each metric against a named row, ``best`` or ``worst``. One row per model."""
    w = Window.partitionBy(F.lit(1))
    out = {}
    for m in metrics:
        base = {"best": F.min(m), "worst": F.max(m)}.get(baseline, F.max(F.when(F.col("model") == baseline, F.col(m))))
        out[f"{m}_improvement"] = (base.over(w) - F.col(m)) / base.over(w) * 100
    return table.withColumns(out)


def average_rank(table: DataFrame, metric: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Ascending rank where ties share the mean of their places; rows without a metric are left out.

    The table is cut into ranges of (by, metric), which never part equal values, and written with its range number. A range ranks
    its own rows; the row counts of the ranges before it, a table of ranges x groups, supply the offset. Nothing is joined on a metric.
    """
    by = list(by)
    ranges = stage(table.where(F.col(metric).isNotNull()).repartitionByRange(*by, metric).withColumn("range__", F.spark_partition_id()), "ranked").table
    counts = ranges.groupBy(*by, "range__").agg(F.count(F.lit(1)).alias("rows__"))
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "range__", F.coalesce(F.sum("rows__").over(before), F.lit(0)).alias("before__"))
    inside = Window.partitionBy(*by, "range__")
    first, ties = F.rank().over(inside.orderBy(metric)), F.count(F.lit(1)).over(Window.partitionBy(*by, "range__", metric))
    return ranges.join(offsets, [*by, "range__"]).withColumn(name, F.col("before__") + first + (ties - 1) / 2).drop("range__", "before__")


def place(table: DataFrame, metric: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """Competition rank (1 + number of smaller), or a strict order when tie-breakers are named, of a table with one row a model."""
    if ties:
        return table.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(metric, *ties)))
    return table.withColumn(name, F.rank().over(Window.partitionBy(F.lit(1)).orderBy(metric)))


def best_and_worst(table: DataFrame, metric: str, k: int = 5, tie: str = "ticker") -> DataFrame:
    """The k lowest and k highest rows by a metric, two bounded top-k sorts."""
    low = table.orderBy(F.col(metric).asc(), F.col(tie).asc()).limit(k).withColumn("side", F.lit("best"))
    high = table.orderBy(F.col(metric).desc(), F.col(tie).asc()).limit(k).withColumn("side", F.lit("worst"))
    return low.unionByName(high)


def extreme_rows(table: DataFrame, metric: str, label: str = "model", by: Sequence[str] = ()) -> DataFrame:
    """Label of the smallest and the largest metric."""
    return table.groupBy(*by).agg(
        F.min_by(label, metric).alias("lowest"), F.min(metric).alias("lowest_value"),
        F.max_by(label, metric).alias("highest"), F.max(metric).alias("highest_value"))


def describe(table: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per group."""
    base = table.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"))
    quart = exact_percentiles(table, by, column, [0.25, 0.5, 0.75])
    named = quart.table.withColumnsRenamed({"p0": "q25", "p1": "median", "p2": "q75"})
    return attach(base, Staged(named, quart.rows), list(by))


def label_regimes(market: DataFrame, dates: DataFrame, q: float = 0.9, value: str = "value") -> Staged:
    """(date, regime): `high` from the q-quantile of the market series over the given dates on, else `low`.

    Both inputs hold one row per date, so the exact percentile is over the calendar.
    """
    scored = stage(market.join(dates.select("date").distinct(), "date", "left_semi").select("date", value), "market")
    cut = scored.table.agg(F.percentile(value, F.lit(q)).alias("cut")).scalar()
    return stage(scored.table.select("date", F.when(F.col(value) >= cut, "high").otherwise("low").alias("regime")),
                 "regimes")


def regime_losses(pred: DataFrame, regimes: Staged, by: Sequence[str] = ("model", "regime", "ticker"), **kw) -> DataFrame:
    return loss_table(attach(pred, regimes, ["date"]), by, **kw)


def error_quartiles(pred: DataFrame, keys: Sequence[str] = ("model",), horizon: int = 1) -> DataFrame:
    """Quartiles of forecast error and forecast ratio, exact, per key.

    A model's cells may outgrow one task, so both go through the partitioned percentile.
    """
    f, y = F.col("yhat") / horizon, F.col("target") / horizon
    cells = pred.select(*keys, F.explode(F.array(
        F.struct(F.lit("error").alias("kind"), (f - y).alias("v")),
        F.struct(F.lit("ratio").alias("kind"), ratio(f, y).alias("v")))).alias("e")).select(*keys, "e.kind", "e.v")
    quart = exact_percentiles(cells, [*keys, "kind"], "v", [0.25, 0.5, 0.75]).table
    return quart.select(*keys, "kind", F.col("p0").alias("q25"), F.col("p1").alias("median"), F.col("p2").alias("q75"))


def residual_stats(pred: DataFrame, by: Sequence[str] = ("model", "ticker")) -> DataFrame:
    """Mean and population deviation of the residual, squared correlation, and R2 per group."""
    e = F.col("target") - F.col("yhat")
    return pred.groupBy(*by).agg(
        F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"),
        F.pow(F.corr("target", "yhat"), F.lit(2.0)).alias("corr2"),
        (1 - F.sum(e * e) / (F.var_pop("target") * F.count("target"))).alias("r2"))


def ticker_leaderboard(pred: DataFrame, **qlike) -> DataFrame:
    cols = loss_columns(**qlike)
    return pred.groupBy("ticker").agg(cols["mse"].alias("mse"), cols["qlike"].alias("qlike"),
                                      F.avg("target").alias("mean_level"))


def group_gaps(table: DataFrame, key: str, metrics: Sequence[str] = ("mse", "qlike")) -> DataFrame:
    """Mean of each metric per group and its percent gap to the best group."""
    means = table.groupBy(key).agg(*[F.avg(m).alias(m) for m in metrics])
    w = Window.partitionBy(F.lit(1))
    return means.withColumns({f"{m}_gap": (F.col(m) / F.min(m).over(w) - 1) * 100 for m in metrics})


def ensemble_mean(pred: DataFrame, by: Sequence[str] = ("run", "origin", "date", "ticker")) -> DataFrame:
    return pred.groupBy(*by).agg(F.avg("yhat").alias("yhat"))


def screen_ensemble(losses: DataFrame, by: Sequence[str] = ("run", "origin"), q: float = 0.5,
                    loss: str = "valid_loss") -> DataFrame:
    """Seeds whose final validation loss does not exceed the q-quantile within their (run, origin)."""
    losses = stage(losses, "seed-losses").table
    cut = exact_percentiles(losses, by, loss, [q])
    threshold = Staged(cut.table.withColumnRenamed("p0", "threshold"), cut.rows)
    return attach(losses, threshold, list(by)).filter(F.col(loss) <= F.col("threshold"))


def effect_decomposition(table: DataFrame, base: str, control: str, full: str, metric: str = "mse") -> DataFrame:
    """How much of a gain comes from extra parameters and how much from their information.

    `base` has no extra inputs, `control` has uninformative ones, `full` the real ones. All three
    effects are percentages of the base loss, and total = parameter + information.
    """
    pick = {n: F.max(F.when(F.col("model") == m, F.col(metric))) for n, m in
            (("base", base), ("control", control), ("full", full))}
    rows = table.agg(*[c.alias(n) for n, c in pick.items()])
    total = (F.col("base") - F.col("full")) / F.col("base") * 100
    param = (F.col("base") - F.col("control")) / F.col("base") * 100
    info = (F.col("control") - F.col("full")) / F.col("base") * 100
    return rows.select("base", "control", "full", total.alias("total_effect"), param.alias("parameter_effect"),
                       info.alias("information_effect"), (info / total * 100).alias("information_share"))


def relative_gain(table: DataFrame, better: str, base: str, by: Sequence[str], metric: str = "mse") -> DataFrame:
    """Percent gain of one model over another within each `by` group (a universe size, a horizon)."""
    a = F.max(F.when(F.col("model") == base, F.col(metric)))
    b = F.max(F.when(F.col("model") == better, F.col(metric)))
    return table.groupBy(*by).agg(a.alias("base"), b.alias("better"), ((a - b) / a * 100).alias("gain"))


def flat_share(history: DataFrame, by: Sequence[str], order: str = "epoch", loss: str = "valid",
               tolerance: float = 1e-6) -> DataFrame:
    """Share of steps that hardly move, and the last loss: the inputs of the restart rule.

    The first step has no difference and counts as moving.
    """
    w = Window.partitionBy(*by).orderBy(order)
    step = F.abs(F.col(loss) - F.lag(loss).over(w))
    return history.withColumn("step", step).groupBy(*by).agg(
        F.avg(F.when(F.col("step") < tolerance, 1.0).otherwise(0.0)).alias("flat_share"),
        F.max_by(loss, order).alias("final_loss"))


def best_so_far(history: DataFrame, by: Sequence[str], order: str = "epoch", loss: str = "valid") -> DataFrame:
    """Adds best_loss and best_step: the lowest loss up to a step and the first step that had it, which is the state a trainer would have kept.

    A step whose loss is missing or not a number never is the best one; before the first sound loss both columns are NULL. Histories are
    bounded by their steps, fits by nothing, so a history is one window partition.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sound = F.when(F.col(loss).isNotNull() & ~F.isnan(loss), F.struct(F.col(loss).alias("loss"), F.col(order).alias("step")))
    return history.withColumn("best", F.min(sound).over(w)).withColumns({"best_loss": F.col("best.loss"), "best_step": F.col("best.step")}).drop("best")


def flat_runs(history: DataFrame, by: Sequence[str], order: str = "epoch", loss: str = "valid", tolerance: float = 1e-6) -> DataFrame:
    """(by, first, last, steps): every maximal run of consecutive steps that hardly move.

    Gaps and islands: a flat step's place among all steps less its place among the flat ones is the same throughout a run.
    """
    w = Window.partitionBy(*by).orderBy(order)
    steps = history.select(*by, order, (F.abs(F.col(loss) - F.lag(loss).over(w)) < tolerance).alias("flat"), F.row_number().over(w).alias("place"))
    flat = steps.where("flat").withColumn("island", F.col("place") - F.row_number().over(w))
    return flat.groupBy(*by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("steps")).drop("island")


def restart_rule(history: DataFrame, by: Sequence[str], order: str = "epoch", loss: str = "valid", tolerance: float = 1e-6,
                 most_flat: float = 0.5, most_loss: float = 100.0) -> DataFrame:
    """(by, flat_share, longest_flat, final_loss, best_step, best_loss, restart): whether a fit must be started again.

    A fit restarts if more than `most_flat` of its steps hardly move, or if its last loss is beyond `most_loss`, missing or not a number.
    """
    last = best_so_far(history, by, order, loss).groupBy(*by).agg(F.max_by("best_step", order).alias("best_step"), F.max_by("best_loss", order).alias("best_loss"))
    longest = flat_runs(history, by, order, loss, tolerance).groupBy(*by).agg(F.max("steps").alias("longest_flat"))
    shares = flat_share(history, by, order, loss, tolerance)
    out = shares.join(last, list(by)).join(longest, list(by), "left").withColumn("longest_flat", F.coalesce("longest_flat", F.lit(0)))
    sound = F.coalesce((F.col("final_loss") <= most_loss) & ~F.isnan("final_loss"), F.lit(False))
    return out.withColumn("restart", (F.col("flat_share") > most_flat) | ~sound)
