"""Panel semantics on a hand-made panel with a hole, a leading gap and an infinity, against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volarium.functions.scalars import finite_or_null, qlike_term
from volarium.operators import backtest, evaluate, har, panel
from volarium.session import stage

DATES = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]


def wide():
    rng = np.random.default_rng(3)
    w = pd.DataFrame(rng.uniform(1, 5, (30, 3)), index=DATES, columns=["A", "B", "C"])
    w.loc[DATES[10], "A"] = np.nan       # hole
    w.loc[DATES[:3], "B"] = np.nan       # leading gap
    return w


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(d, t, float(v)) for d, r in wide().iterrows() for t, v in r.items() if v == v]
    return stage(spark.createDataFrame(rows, "date date, ticker string, value double"), "cells").table


def to_wide(df, value):
    return df.toPandas().pivot(index="date", columns="ticker", values=value).astype(float)


def same(a, b):
    pd.testing.assert_frame_equal(a.sort_index(axis=1), b.sort_index(axis=1), check_names=False, check_freq=False)


def test_densify_keeps_holes(cells):
    dense = panel.densify(cells)
    same(to_wide(dense, "value"), wide())
    assert dense.agg(F.max("pos"), F.max("n_dates")).first()[:] == (29, 30)


def test_forward_fill_leaves_the_head(cells):
    same(to_wide(panel.forward_fill(panel.densify(cells), "value"), "value"), wide().ffill())
    same(to_wide(panel.fill_all(panel.densify(cells), "value"), "value"), wide().ffill().bfill())


@pytest.mark.parametrize("kind", ["nested", "disjoint", "partial"])
def test_lag_means(cells, kind):
    w, out = wide(), har.har_features(panel.densify(cells), har=kind)
    for name, (a, b) in har.__dict__["DISJOINT" if kind == "disjoint" else "NESTED"].items():
        if kind == "partial":
            want = w.rolling(b, min_periods=1).mean().shift(1)
        else:
            want = sum(w.shift(k) for k in range(a, b + 1)) / (b - a + 1)
        same(to_wide(out, name), want)


def test_zero_warmup(cells):
    filled = panel.fill_all(panel.densify(cells), "value")
    out = to_wide(har.har_features(filled, warmup="zero"), "m")
    assert (out.iloc[:22] == 0).all().all() and (out.iloc[22:] > 0).all().all()


def test_forward_targets(cells):
    w, d = wide(), panel.densify(cells)
    same(to_wide(har.forward_sum(d, "value", 5, "s"), "s"), sum(w.shift(-i) for i in range(5)))
    same(to_wide(har.forward_mean(d, "value", 3, "s"), "s"), sum(w.shift(-i) for i in range(1, 4)) / 3)


def test_all_null_sum_is_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "k string, v double")
    assert {r.k: r.s for r in df.groupBy("k").agg(F.sum("v").alias("s")).collect()} == {"a": None, "b": 1.0}


def test_infinities_become_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (2.0,)], "x double")
    assert [r.y for r in df.select(finite_or_null("x").alias("y")).collect()] == [None, None, None, 2.0]


def test_complete_dates_and_alignment(cells):
    kept = {r.date for r in panel.complete_dates(panel.densify(cells), "value").select("date").collect()}
    assert kept == set(wide().dropna().index)
    a, b = panel.align([cells.filter("ticker <> 'C'"), cells.filter("date > '2024-01-05'")])
    for df in (a, b):
        assert {r.ticker for r in df.select("ticker").distinct().collect()} == {"A", "B"}
        assert df.agg(F.min("date")).first()[0] == dt.date(2024, 1, 6)


def test_melt_and_widen_are_inverse(cells):
    w = panel.widen(cells, ["A", "B", "C"])
    same(to_wide(panel.melt(w), "value"), wide())


def test_split_and_origins(cells):
    dense = panel.densify(cells)
    train, test = panel.split_by_fraction(dense, 0.7)
    assert train.agg(F.max("pos")).first()[0] == 20 and test.agg(F.min("pos")).first()[0] == 21
    got = panel.every_kth(dense, 5, 11).select("pos").distinct().orderBy("pos").collect()
    assert [r.pos for r in got] == [5, 16, 27]


def test_origin_ranges_match_a_range_join(cells):
    dense = panel.densify(cells)
    got = backtest.assign_origins(dense, first=8, step=6, look_back=10, validation=3).select("origin", "pos", "ticker", "part")
    want = set()
    for o in range(8, 30, 6):
        f = min(o + 6, 29)
        for p in range(max(o - 10, 0), f):
            for t in "ABC":
                want.add((o, p, t, "test" if p >= o else "valid" if p >= o - 3 else "train"))
    assert {tuple(r) for r in got.collect()} == want
    sched = {r.origin: (r.s_pos, r.v_pos, r.o_pos, r.f_pos) for r in backtest.schedule(dense, 8, 6, 10, 3).collect()}
    assert sched == {o: (max(o - 10, 0), o - 3, o, min(o + 6, 29)) for o in range(8, 30, 6)}


def test_trailing_min_equals_a_sliding_frame(cells):
    filled = panel.fill_all(panel.densify(cells), "value").withColumnRenamed("value", "target")
    got = to_wide(backtest.trailing_min(filled, "target", 7, "low"), "low")
    same(got, wide().ffill().bfill().rolling(7, min_periods=1).min().shift(1))


FLOOR_CASES = {"min_if_nonpositive": [0.5, 0.5, 0.2, 3.0], "clip_to_min": [0.5, 0.5, 0.5, 3.0],
               "min_eps_if_nonpositive": [0.5, 0.5, 0.2, 3.0], "constant": [0.01, 0.01, 0.2, 3.0],
               "forward_fill": [None, None, 0.2, 3.0]}


@pytest.mark.parametrize("policy", backtest.FLOORS)
def test_floor_policies(spark, policy):
    rows = [(DATES[i], "A", y, 0.5) for i, y in enumerate([0.0, -1.0, 0.2, 3.0])]
    df = spark.createDataFrame(rows, "date date, ticker string, yhat double, train_min double")
    out = backtest.floor_forecasts(df, policy).orderBy("date").collect()
    assert [r.yhat for r in out] == FLOOR_CASES[policy]


def test_floor_policy_is_checked(spark):
    with pytest.raises(ValueError):
        backtest.floor_forecasts(spark.range(1).withColumn("yhat", F.lit(1.0)), "other")


def test_qlike_edges(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 0.0), (1.0, -1.0), (None, 1.0)], "y double, f double")
    out = [r.q for r in df.select(qlike_term("y", "f").alias("q")).collect()]
    assert out[0] == pytest.approx(2 - np.log(2) - 1)
    assert np.isnan(out[1]) and np.isnan(out[2]) and out[3] is None
    floored = [r.q for r in df.select(qlike_term("y", "f", eps_pred=0.5).alias("q")).collect()]
    assert floored[1] == pytest.approx(2 - np.log(2) - 1)


def test_missing_truth_and_bad_forecasts_fail(spark):
    pred = spark.createDataFrame([(DATES[0], "A", 1.0), (DATES[1], "A", 0.0)], "date date, ticker string, yhat double")
    truth = spark.createDataFrame([(DATES[0], "A", 1.0)], "date date, ticker string, target double")
    with pytest.raises(Exception, match="no truth"):
        evaluate.align_truth(pred, truth).collect()
    with pytest.raises(Exception, match="not positive"):
        evaluate.assert_positive(pred).collect()


def test_a_bad_forecast_stops_the_query_that_scores_it(spark, sf, monkeypatch):
    from volarium.plans import catalog_evaluate
    from volarium.plans.catalog import CATALOG

    good = catalog_evaluate.predictions(spark, sf)
    monkeypatch.setattr(catalog_evaluate, "predictions", lambda *_: good.withColumn("yhat", F.when(F.col("pos") == 100, F.lit(0.0)).otherwise(F.col("yhat"))))
    with pytest.raises(Exception, match="not positive"):
        CATALOG["asserted_forecast_losses"].run(spark, sf).collect()


def test_running_best_flat_runs_and_restarts(spark):
    nan = float("nan")
    fits = {"down": [5.0, 4.0, 3.0, 3.0, 2.5], "flat": [7.0, 7.0, 7.0, 7.0, 1.0, 1.0], "high": [3.0, 900.0], "broken": [2.0, 1.0, nan], "gap": [None, 3.0, None, 3.0], "one": [1.0]}
    df = spark.createDataFrame([(k, i + 1, v) for k, vs in fits.items() for i, v in enumerate(vs)], "run string, epoch int, valid double").repartition(4)
    best = {(r.run, r.epoch): (r.best_loss, r.best_step) for r in evaluate.best_so_far(df, ["run"]).collect()}
    assert [best["down", k] for k in (1, 3, 4, 5)] == [(5.0, 1), (3.0, 3), (3.0, 3), (2.5, 5)]
    assert best["broken", 3] == (1.0, 2) and best["gap", 1] == (None, None) and best["gap", 4] == (3.0, 2) and best["flat", 6] == (1.0, 5)
    runs = {(r.run, r["first"]): (r["last"], r.steps) for r in evaluate.flat_runs(df, ["run"]).collect()}
    assert runs == {("down", 4): (4, 1), ("flat", 2): (4, 3), ("flat", 6): (6, 1)}
    rule = {r.run: r for r in evaluate.restart_rule(df, ["run"]).collect()}
    assert {k for k, r in rule.items() if r.restart} == {"flat", "high", "broken"} and rule["flat"].longest_flat == 3 and rule["one"].longest_flat == 0
    assert rule["flat"].flat_share == pytest.approx(4 / 6) and (rule["broken"].best_step, rule["broken"].best_loss) == (2, 1.0)


def test_average_rank_by_group_and_without_metric(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 400).astype(str), "v": rng.integers(0, 30, 400).astype(float), "i": range(400)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("0", None, 999)], "g string, v double, i long"))
    got = evaluate.average_rank(df, "v", "r", ["g"]).orderBy("i").collect()
    assert [r.r for r in got] == pdf.groupby("g").v.rank().tolist()


def test_average_rank_matches_pandas(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, 0.5, 0.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = evaluate.average_rank(df, "v", "r").orderBy("i").collect()
    assert [r.r for r in out] == pd.Series(values).rank().tolist()


def test_effects_add_up(spark):
    # Published worked example: base 1.064870, control 1.075603, full 1.004503.
    df = spark.createDataFrame([("a", 1.064870), ("b", 1.075603), ("c", 1.004503)], "model string, mse double")
    e = evaluate.effect_decomposition(df, "a", "b", "c").first()
    assert e.total_effect == pytest.approx(e.parameter_effect + e.information_effect)
    assert round(e.total_effect, 2) == 5.67 and round(e.parameter_effect, 2) == -1.01 and round(e.information_effect, 2) == 6.68


def test_published_improvement_columns(spark):
    rows = [("HAR", 0.008105), ("true", 0.008092), ("random", 0.008034)]
    out = evaluate.improvement(spark.createDataFrame(rows, "model string, mse double"), "HAR", ["mse"]).collect()
    got = {r.model: r.mse_improvement for r in out}
    assert got["HAR"] == 0 and got["random"] == pytest.approx((0.008105 - 0.008034) / 0.008105 * 100)


def test_a_large_grid_is_dealt_by_its_own_size(spark, monkeypatch):
    """Few observed cells of many tickers on a long calendar: tasks follow the cells of the grid, not the bytes that are shuffled."""
    rows = [(f"t{k:02d}", dt.date(2024, 1, 1) + dt.timedelta(days=(7 * k + j) % 50), float(k + j)) for k in range(40) for j in (0, 3)]
    few = spark.createDataFrame(rows, "ticker string, date date, value double")
    whole = sorted(map(tuple, panel.densify(few).collect()), key=repr)
    monkeypatch.setattr(panel, "GRID_ROWS", 100, raising=False)
    dense = panel.forward_fill(panel.densify(few), "value")
    assert dense.rdd.getNumPartitions() >= 40 * few.select("date").distinct().count() * 0.8 // 100
    assert sorted(map(tuple, panel.densify(few).collect()), key=repr) == whole
