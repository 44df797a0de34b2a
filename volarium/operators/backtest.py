"""Rolling-origin backtests: every origin is a column value, all origins run in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volarium.operators.graph import graph_panel, term_columns
from volarium.operators.panel import calendar
from volarium.operators.regress import additive_terms, fit_ols, gram_names, gram_terms, predict, solve_gram
from volarium.session import Staged, attach, stage

# Dates between two fits, longest training span, validation dates before an origin.
STEP = 22
LOOK_BACK = 1000
VALIDATION = 22


def renumber(features: DataFrame) -> DataFrame:
    """Positions over the dates that carry features (the warm-up dates no longer count)."""
    cal = stage(calendar(features), "calendar")
    return attach(features.drop("pos", "n_dates"), cal, ["date"]).withColumn("n_dates", F.lit(cal.rows))


def origin_of(pos: str | Column, first: int, step: int = STEP) -> Column:
    """The origin whose forecast span holds a position."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return (F.lit(first) + F.floor((pos - first) / step) * step).cast("int")


def schedule(features: DataFrame, first: int, step: int = STEP, look_back: int = LOOK_BACK,
             validation: int = VALIDATION) -> DataFrame:
    """Origins with the positions that bound training [s, v), validation [v, o) and forecast [o, f).

    f stops at the last position, so the last date of the panel is never forecast.
    """
    last = F.max("pos")
    span = features.agg(last.alias("last")).filter(F.col("last") >= first)
    o = span.select("last", F.explode(F.sequence(F.lit(first), F.col("last"), F.lit(step))).alias("origin"))
    return o.select(
        "origin", F.greatest(F.col("origin") - look_back, F.lit(0)).alias("s_pos"),
        (F.col("origin") - validation).alias("v_pos"), F.col("origin").alias("o_pos"),
        F.least(F.col("origin") + step, F.col("last")).alias("f_pos"))


def assign_origins(rows: DataFrame, first: int, step: int = STEP, look_back: int = LOOK_BACK,
                   validation: int = VALIDATION) -> DataFrame:
    """Range join of rows with the origins whose span holds their date, with the role of each pair.

    The origins around a position follow from arithmetic, so this is a generator: no range join, no
    broadcast. Adds `origin` and `part` (train, valid, test). Rows repeat once per covering origin.
    """
    k_last = F.floor((F.col("n_dates") - 1 - first) / step)
    low = F.greatest(F.floor((F.col("pos") - first) / step), F.lit(0))
    high = F.least(F.floor((F.col("pos") + look_back - first) / step), k_last)
    spread = rows.filter(low <= high).withColumn("origin", F.explode(F.sequence(low, high)))
    spread = spread.withColumn("origin", (F.col("origin") * step + first).cast("int"))
    part = (F.when(F.col("pos") >= F.col("origin"), "test")
            .when(F.col("pos") >= F.col("origin") - validation, "valid").otherwise("train"))
    return spread.withColumn("part", part).filter(~((F.col("part") == "test") & (F.col("pos") >= F.col("n_dates") - 1)))


def test_rows(rows: DataFrame, first: int, step: int = STEP) -> DataFrame:
    """Each forecast date belongs to exactly one origin."""
    keep = rows.filter((F.col("pos") >= first) & (F.col("pos") < F.col("n_dates") - 1))
    return keep.withColumn("origin", origin_of("pos", first, step))


def rolling_ols(features: DataFrame, xs: Sequence[str], first: int, step: int = STEP,
                look_back: int = LOOK_BACK) -> Staged:
    """One OLS per origin over the dates before it, reading the panel once.

    The panel is reduced to one Gram per date; an origin's Gram is the sum over its look-back span.
    The window is global but runs over the calendar (one row per date), never over the panel.
    """
    per_date = additive_terms(features.groupBy("pos").agg(*gram_terms(xs)), len(xs), ["pos"])
    w = Window.partitionBy(F.lit(1)).orderBy("pos").rangeBetween(-look_back, -1)
    sums = {c: F.col(c) if c.startswith("g_p") else F.sum(c).over(w) for c in gram_names(len(xs))}
    windowed = per_date.select("pos", *[s.alias(c) for c, s in sums.items()])
    at_origins = windowed.filter((F.col("pos") >= first) & (F.pmod(F.col("pos") - first, F.lit(step)) == 0))
    return stage(solve_gram(at_origins.withColumnRenamed("pos", "origin"), len(xs), ["origin"]), "rolling-ols")


def rolling_forecast(features: DataFrame, xs: Sequence[str], first: int, step: int = STEP,
                     look_back: int = LOOK_BACK) -> DataFrame:
    """Forecasts of every origin: features plus `origin` and `yhat`."""
    coef = rolling_ols(features, xs, first, step, look_back)
    return predict(test_rows(features, first, step), coef, xs, ["origin"])


def rolling_graph_forecast(features: DataFrame, edges: Staged, columns: Sequence[str], terms: Sequence[str],
                           first: int, step: int = STEP, look_back: int = LOOK_BACK) -> DataFrame:
    """Like `rolling_forecast` when every origin has graphs of its own (`edges` has an `origin` column).

    Graph features then differ per origin, so the training rows repeat once per covering origin. They
    are reduced to Grams within the job that makes them; only the forecast rows (one origin each) are
    computed a second time.
    """
    xs = term_columns(terms, columns)
    train = assign_origins(features, first, step, look_back).filter("part <> 'test'")
    coef = fit_ols(graph_panel(train, edges, columns, terms, on=["origin"]), xs, by=["origin"])
    return predict(graph_panel(test_rows(features, first, step), edges, columns, terms, on=["origin"]),
                   coef, xs, ["origin"])


def trailing_min(rows: DataFrame, column: str, span: int, name: str) -> DataFrame:
    """Per ticker, the minimum over the `span` positions before each row, in constant work per row.

    Positions are cut into blocks of `span`; a trailing window is the tail of one block and the head of
    the next, so two running minima answer it. A sliding frame would re-read `span` rows for each row.
    Needs consecutive positions per ticker.
    """
    blocks = Window.partitionBy("ticker", "blk")
    rows = rows.withColumn("blk", F.floor(F.col("pos") / span))
    rows = rows.withColumns({
        "head": F.min(column).over(blocks.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)),
        "tail": F.min(column).over(blocks.orderBy("pos").rowsBetween(0, Window.unboundedFollowing)),
    })
    w = Window.partitionBy("ticker").orderBy("pos")
    return rows.withColumn(name, F.least(F.lag("head", 1).over(w), F.lag("tail", span).over(w))) \
        .drop("blk", "head", "tail")


def training_minimum(features: DataFrame, first: int, step: int = STEP, look_back: int = LOOK_BACK) -> DataFrame:
    """(origin, ticker, train_min): smallest training target of the ticker before each origin."""
    mins = trailing_min(features, "target", look_back, "train_min")
    at = mins.filter((F.col("pos") >= first) & (F.pmod(F.col("pos") - first, F.lit(step)) == 0))
    return at.select(F.col("pos").alias("origin"), "ticker", "train_min")


FLOORS = ("min_if_nonpositive", "clip_to_min", "min_eps_if_nonpositive", "constant", "forward_fill")


def floor_forecasts(pred: DataFrame, policy: str, yhat: str = "yhat", train_min: str = "train_min",
                    constant: float = 0.01) -> DataFrame:
    """Repair forecasts that a variance cannot take.

    ``min_if_nonpositive``: <= 0 becomes the ticker's training minimum; ``clip_to_min``: nothing below
    that minimum; ``min_eps_if_nonpositive``: <= 0 becomes the larger of the minimum and 1e-6;
    ``constant``: nothing below `constant`; ``forward_fill``: <= 0 repeats the ticker's last positive one.
    """
    f = F.col(yhat)
    if policy == "min_if_nonpositive":
        return pred.withColumn(yhat, F.when(f <= 0, F.col(train_min)).otherwise(f))
    if policy == "clip_to_min":
        return pred.withColumn(yhat, F.when(f.isNotNull(), F.greatest(f, F.col(train_min))))
    if policy == "min_eps_if_nonpositive":
        return pred.withColumn(yhat, F.when(f <= 0, F.greatest(F.col(train_min), F.lit(1e-6))).otherwise(f))
    if policy == "constant":
        return pred.withColumn(yhat, F.when(f.isNotNull(), F.greatest(f, F.lit(constant))))
    if policy == "forward_fill":
        w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return pred.withColumn(yhat, F.last(F.when(f > 0, f), ignorenulls=True).over(w))
    raise ValueError(f"policy must be one of {FLOORS}, found {policy!r}")
