import numpy as np
import pytest
from pyspark.sql import functions as F

from volarium.operators import mcs
from volarium.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def losses(spark):
    rng = np.random.default_rng(0)
    rows = [(m, f"u{k:03}", float(level + 0.1 * rng.normal())) for m, level in (("good", 1.0), ("fair", 1.02), ("bad", 3.0)) for k in range(60)]
    return spark.createDataFrame(rows, "model string, ticker string, mse double")


@pytest.mark.parametrize("algorithm", ["SQ", "R"])
def test_worst_model_leaves_first(losses, algorithm):
    rows = mcs.confidence_set(losses, "ticker", ["good", "fair", "bad"], "mse", n_boot=300, algorithm=algorithm).orderBy("step").collect()
    assert rows[0].model == "bad" and not rows[0].included and rows[0].p_value == 0
    p = [r.p_value for r in rows]
    assert p == sorted(p) and p[-1] == 1 and rows[-1].included


def brute(matrix, idx, algorithm):
    """The test by direct array arithmetic on the same draws."""
    boot, mean, m = matrix[idx].mean(1), matrix.mean(0), matrix.shape[1]
    d, ds = mean[None] - mean[:, None], boot[:, None, :] - boot[:, :, None]
    var = ((ds - d) ** 2).mean(0) + np.eye(m)
    z, obs, alive, out = (ds - d) / np.sqrt(var), d / np.sqrt(var), list(range(m)), []
    while len(alive) > 1:
        sub = np.ix_(alive, alive)
        zz, oo = z[(slice(None), *sub)], obs[sub]
        stat = np.abs(zz).max((1, 2)) if algorithm == "R" else (zz ** 2).sum((1, 2)) / 2
        p = (stat > (oo.max() if algorithm == "R" else (oo ** 2).sum() / 2)).mean()
        k = len(alive)
        db, dbs = d[sub].mean(0) * k / (k - 1), ds[(slice(None), *sub)].mean(1) * k / (k - 1)
        worst = alive[int(np.argmax(db / np.sqrt(((dbs - db) ** 2).mean(0))))]
        out.append((worst, p))
        alive.remove(worst)
    return [w for w, _ in out] + alive, np.maximum.accumulate([p for _, p in out] + [1.0])


@pytest.mark.parametrize("algorithm", ["SQ", "R"])
def test_against_brute_force(spark, algorithm):
    rng = np.random.default_rng(8)
    names = ["a", "b", "c", "d"]
    rows = [(m, f"u{k:03}", float(1 + 0.03 * i + rng.normal() * 0.2)) for i, m in enumerate(names) for k in range(40)]
    df = spark.createDataFrame(rows, "model string, ticker string, mse double")
    matrix = mcs.loss_matrix(df, "ticker", names, "mse")
    draws = mcs.bootstrap_draws(matrix, 200, 3).toPandas().sort_values(["b", "pos"])
    idx = draws.idx.to_numpy().reshape(200, 40)
    wide = matrix.table.toPandas().sort_values("pos")[["l0", "l1", "l2", "l3"]].to_numpy()
    order, p = brute(wide, idx, algorithm)
    got = mcs.confidence_set(df, "ticker", names, "mse", n_boot=200, block=3, algorithm=algorithm).orderBy("step").collect()
    assert [r.model for r in got] == [names[i] for i in order]
    np.testing.assert_allclose([r.p_value for r in got], p)


@pytest.mark.parametrize("slice_rows", [1, 7, 59, 60])
def test_draws_do_not_depend_on_the_slices(spark, losses, slice_rows):
    """Blocks that are open at the end of a slice, also over several slices, go on in the next one."""
    matrix = mcs.loss_matrix(losses, "ticker", ["good", "fair", "bad"], "mse")
    rows = lambda d: sorted(map(tuple, d.collect()))
    whole = rows(mcs.bootstrap_draws(matrix, 30, 9, seed=3))
    assert rows(mcs.bootstrap_draws(matrix, 30, 9, 3, slice_rows)) == whole and len(whole) == 1800
    lengths = mcs.Lengths(spark.createDataFrame([(60,), (60,), (8,)], "t long"), 60)
    both = rows(mcs.bootstrap_draws(lengths, 30, 9, 3, slice_rows))
    assert [r[1:] for r in both if r[0] == 60] == whole and len(both) == 30 * 68
    assert [r[1:] for r in both if r[0] == 8] == [tuple(r) for r in rows(mcs.bootstrap_draws(mcs.Staged(matrix.table, 8), 30, 9, 3))]


@pytest.mark.parametrize("algorithm", ["SQ", "R"])
def test_all_sets_at_once(spark, algorithm):
    """Sets of different sizes, one of them under a null key, each against direct arithmetic on its own draws."""
    rng = np.random.default_rng(5)
    names, sizes = ["a", "b", "c", "d", "e"], {("low", 1): 30, ("high", 1): 18, (None, 2): 30}
    data = {k: 1 + rng.normal(size=(t, 1)) + 0.05 * np.arange(5) + rng.normal(size=(t, 5)) * 0.3 for k, t in sizes.items()}
    rows = [(*k, f"u{u:03}", m, float(x[u, i])) for k, x in data.items() for u in range(len(x)) for i, m in enumerate(names)]
    df = spark.createDataFrame(rows, "regime string, horizon int, ticker string, model string, loss double").repartition(7)
    got = mcs.confidence_sets(df, ["regime", "horizon"], "ticker", names, "loss", n_boot=150, block=3, algorithm=algorithm, seed=2).collect()
    assert len(got) == 15
    for k, x in data.items():
        draws = mcs.bootstrap_draws(mcs.Staged(df, len(x)), 150, 3, 2).toPandas().sort_values(["b", "pos"])
        order, p = brute(x, draws.idx.to_numpy().reshape(150, len(x)), algorithm)
        mine = sorted((r.step, r.model, r.p_value, r.included) for r in got if (r.regime, r.horizon) == k)
        assert [r[1] for r in mine] == [names[i] for i in order]
        np.testing.assert_allclose([r[2] for r in mine], p)
        assert [r[3] for r in mine] == [v > 0.05 for v in p]


def test_a_hundred_models(spark):
    rng = np.random.default_rng(11)
    names, t = [f"m{k:03}" for k in range(100)], 24
    x = 1 + 0.01 * rng.permutation(100) + rng.normal(size=(t, 100)) * 0.2
    df = spark.createDataFrame([(f"u{u:03}", m, float(x[u, i])) for u in range(t) for i, m in enumerate(names)], "ticker string, model string, loss double")
    got = mcs.confidence_set(df, "ticker", names, "loss", n_boot=40, block=2).orderBy("step").collect()
    draws = mcs.bootstrap_draws(mcs.Staged(df, t), 40, 2).toPandas().sort_values(["b", "pos"])
    order, p = brute(x, draws.idx.to_numpy().reshape(40, t), "SQ")
    assert [r.model for r in got] == [names[i] for i in order]
    np.testing.assert_allclose([r.p_value for r in got], p)


def test_reports_in_the_given_order(spark):
    rng = np.random.default_rng(2)
    rows = [(g, f"u{k}", m, float(level + rng.normal() * 0.1)) for g in ("low", "high") for k in range(15) for m, level in (("a", 1.0), ("b", 2.0), ("c", 4.0))]
    df = spark.createDataFrame(rows, "regime string, ticker string, model string, loss double")
    got = mcs.confidence_reports(df, ["regime"], "ticker", ["a", "b", "c"], "b", "loss", shown=["c", "b"], n_boot=60).orderBy("regime", "place").collect()
    assert [(r.regime, r.place, r.model, r["rank"]) for r in got] == [(g, k + 1, m, w) for g in ("high", "low") for k, (m, w) in enumerate((("c", 3.0), ("b", 2.0)))]
    mean = df.toPandas().groupby(["regime", "model"]).loss.mean()
    for r in got:
        assert r.loss_ratio == pytest.approx(mean[r.regime, r.model] / mean[r.regime, "b"]) and r.loss == pytest.approx(mean[r.regime, r.model])


def test_blocks_run_on_and_wrap(losses):
    matrix = mcs.loss_matrix(losses, "ticker", ["good", "fair", "bad"], "mse")
    d = mcs.bootstrap_draws(matrix, 50, 4).toPandas().sort_values(["b", "pos"])
    step = d.groupby("b").idx.diff().dropna()
    share = ((step == 1) | (step == -59)).mean()
    assert d.idx.between(0, 59).all() and 0.68 < share < 0.85  # about 1 - 1/4 + 1/4 * 1/60


def test_identical_models_do_not_break_the_test(spark):
    rows = [(m, f"u{k}", float(k % 7 + (m == "c"))) for m in "abc" for k in range(20)]
    df = spark.createDataFrame(rows, "model string, ticker string, mse double")
    out = mcs.confidence_set(df, "ticker", list("abc"), "mse", n_boot=50).orderBy("step").collect()
    assert out[0].model == "c" and len(out) == 3


@pytest.mark.parametrize("kw,error", [({"alpha": 2}, ValueError), ({"n_boot": 0}, ValueError), ({"block": 0.5}, ValueError),
                                      ({"algorithm": "X"}, TypeError)])
def test_arguments(losses, kw, error):
    with pytest.raises(error):
        mcs.confidence_set(losses, "ticker", ["good", "fair"], "mse", **kw)


def test_a_missing_loss_is_an_error(spark):
    from volarium.operators.mcs import loss_matrix

    for bad in (None, float("nan")):
        losses = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", bad), ("b", "m1", 1.0), ("b", "m2", 2.0)], "ticker string, model string, mse double")
        with pytest.raises(ValueError):
            loss_matrix(losses, "ticker", ["m1", "m2"], "mse")


@pytest.mark.parametrize("name", ["confidence_set_by_ticker", "confidence_set_by_date", "confidence_report", "loss_difference_moments", "block_bootstrap"])
def test_queries_draw_as_many_resamples_as_the_reference(spark, sf, name, monkeypatch):
    class Asked(Exception):
        pass

    def draws(rows, n_boot, block, seed=0):
        raise Asked(n_boot)
    monkeypatch.setattr(mcs, "bootstrap_draws", draws)
    with pytest.raises(Asked, match="^10000$"):
        CATALOG[name].run(spark, sf)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_over_several_slices_join_nothing(spark):
    """A generator's output counts as small, so that a join would broadcast every position of every resample."""
    draws = mcs.bootstrap_draws(mcs.Staged(spark.range(0), 9000), 3, 4, seed=7)
    assert "Join" not in plan_of(draws)
    assert draws.groupBy("b").agg(F.count("pos").alias("n"), F.max("pos").alias("last"), F.count("idx").alias("drawn")).select("n", "last", "drawn").distinct().collect() == [(9000, 8999, 9000)]


def test_a_side_behind_a_generator_is_not_broadcast(spark):
    from volarium.session import attach

    many = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(50))).alias("k"))
    small = mcs.Staged(spark.range(40).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("v")), 40)
    joined = attach(many, small, ["k"], max_rows=10)
    assert "Broadcast" not in plan_of(joined) and joined.count() == 39
