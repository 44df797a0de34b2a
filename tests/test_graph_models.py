import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from volarium.operators import backtest, control, glasso, gnn, graph, panel, regress
from volarium.session import Staged, stage
from volarium.sources.universes import SIX_NODE_PAIRS

NODES = ["AXP", "BA", "CVX", "GS", "IBM", "JPM"]
DAY0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def six(spark):
    pairs = spark.createDataFrame(SIX_NODE_PAIRS, "src string, dst string")
    return stage(graph.edges_from_list(pairs, "six"), "six").table


def matrix(edges, names=NODES):
    m = np.zeros((len(names), len(names)))
    for r in edges.collect():
        m[names.index(r.dst), names.index(r.src)] = r.w
    return m


def test_six_node_graph(six):
    assert six.count() == 16
    w = matrix(graph.normalise(six, eps=0.0))
    assert np.allclose(w, w.T) and np.allclose(np.diag(w), 0)
    values = {round(v, 6) for v in w[w > 0]}
    assert values == {round(1 / 3, 6), round(1 / np.sqrt(6), 6), 0.5}
    deg = {r.src: r.degree for r in graph.degrees(six).collect()}
    assert deg == {"IBM": 3, "JPM": 3, "GS": 3, "CVX": 2, "AXP": 2, "BA": 3}
    assert graph.density(six, 6).first().density == pytest.approx(16 / 30)


def test_random_graphs_are_seeded_and_symmetric(spark):
    nodes = graph.number_nodes(spark.createDataFrame([(n,) for n in NODES], "ticker string"))
    one = lambda: matrix(graph.random_edges(nodes, "bernoulli", [5], 0.5))
    assert np.array_equal(one(), one()) and np.array_equal(one(), one().T)
    u = matrix(graph.random_edges(nodes, "uniform", [5]))
    assert (u[~np.eye(6, dtype=bool)] > 0).all() and np.array_equal(u, u.T)
    with pytest.raises(ValueError):
        graph.random_edges(nodes, "other", [1])


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p in range(80):
        for k, n in enumerate(NODES):
            x = rng.uniform(0.5, 2, 3)
            rows.append((DAY0 + dt.timedelta(days=p), p, 80, n, float(0.3 + x @ [0.4, 0.2, 0.1] + 0.02 * rng.normal()), *map(float, x)))
    df = spark.createDataFrame(rows, "date date, pos int, n_dates int, ticker string, target double, d double, w double, m double")
    return stage(df, "features").table


def edges_of(spark, six, extra=None):
    nodes = spark.createDataFrame([(n,) for n in NODES], "ticker string")
    e = graph.identity_edges(nodes).unionByName(graph.normalise(six))
    return stage(e, "edges")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_graph_product_with_broadcast_and_with_shuffle(spark, six, features, limit, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", limit)
    # A missing neighbour contributes nothing.
    holed = features.filter("NOT (ticker = 'BA' AND pos = 3)")
    out = graph.graph_panel(holed, edges_of(spark, six), ["d", "w"], ["self", "six"]).toPandas()
    w = matrix(graph.normalise(six))
    x = holed.toPandas().pivot(index="pos", columns="ticker", values="d").fillna(0)
    want = x.to_numpy() @ w.T
    for r in out.itertuples():
        assert r.six_d == pytest.approx(want[list(x.index).index(r.pos), NODES.index(r.ticker)])
    assert len(out) == 80 * 6 - 1
    prop = graph.propagate(holed, stage(graph.normalise(six), "links"), ["d"]).count()
    assert prop == 80 * 6


def test_blocked_moments_match_numpy(spark, features):
    wide = features.toPandas().pivot(index="pos", columns="ticker", values="d")
    for block, chunk in ((2, 30), (100, 1000)):
        m = stage(graph.cross_moments(features, "d", [], block=block, chunk=chunk), "moments").table
        cov = {(r.src, r.dst): r.cov for r in graph.covariances(m).collect()}
        want = np.cov(wide.to_numpy().T, ddof=0)
        assert len(cov) == 21
        for (a, b), v in cov.items():
            assert v == pytest.approx(want[NODES.index(a), NODES.index(b)], abs=1e-12)
        corr = {(r.src, r.dst): r.corr for r in graph.correlations(m).collect()}
        assert corr[("AXP", "JPM")] == pytest.approx(np.corrcoef(wide.AXP, wide.JPM)[0, 1])


def lstsq(pdf, xs):
    a = np.column_stack([np.ones(len(pdf)), pdf[xs]])
    return np.linalg.lstsq(a, pdf.target, rcond=None)[0]


def test_least_squares(features):
    xs, pdf = ["d", "w", "m"], features.toPandas()
    fit = regress.fit_ols(features, xs).table.first()
    want = lstsq(pdf, xs)
    np.testing.assert_allclose([fit.intercept, *fit.beta], want, rtol=1e-9)
    assert fit.n == 480 and fit.rank == 3
    scored = regress.predict(features, regress.fit_ols(features, xs), xs).toPandas()
    e = scored.target - scored.yhat
    np.testing.assert_allclose([e.sum(), *(e @ scored[xs])], 0, atol=1e-8)
    both = regress.fit_nested(features, {"a": ["w"], "b": xs}).table.collect()
    got = {r.model: [r.intercept, *r.beta] for r in both}
    np.testing.assert_allclose(got["a"], lstsq(pdf, ["w"]), rtol=1e-9)
    np.testing.assert_allclose(got["b"], want, rtol=1e-9)


def test_collinear_features_get_the_minimum_norm_fit(features):
    df = features.withColumn("d2", F.col("d"))
    fit = regress.fit_ols(df, ["d", "d2", "w"]).table.first()
    assert fit.rank == 2 and fit.beta[0] == pytest.approx(fit.beta[1])
    pdf = df.toPandas()
    c = pdf[["d", "d2", "w"]] - pdf[["d", "d2", "w"]].mean()
    want = np.linalg.pinv(c.to_numpy()) @ (pdf.target - pdf.target.mean())
    np.testing.assert_allclose(fit.beta, want, rtol=1e-8)


def test_fixed_effects(features):
    xs, pdf = ["d", "w", "m"], features.withColumn("target", F.col("target") + F.length("ticker")).toPandas()
    df = features.withColumn("target", F.col("target") + F.length("ticker"))
    slopes, alphas = regress.fit_fixed_effects(df, xs)
    dummies = np.column_stack([pdf[xs], *[(pdf.ticker == n) * 1.0 for n in NODES]])
    want = np.linalg.lstsq(dummies, pdf.target, rcond=None)[0]
    np.testing.assert_allclose(slopes.table.first().beta, want[:3], rtol=1e-9)
    got = {r.ticker: r.alpha for r in alphas.table.collect()}
    np.testing.assert_allclose([got[n] for n in NODES], want[3:], rtol=1e-9)


def test_rolling_fit_equals_separate_fits(features):
    xs, pdf = ["d", "w", "m"], features.toPandas()
    out = backtest.rolling_forecast(features, xs, first=30, step=10, look_back=25).toPandas()
    assert set(out.pos) == set(range(30, 79))  # the last date is never forecast
    for o in range(30, 79, 10):
        b = lstsq(pdf[(pdf.pos >= o - 25) & (pdf.pos < o)], xs)
        part = out[out.origin == o]
        np.testing.assert_allclose(part.yhat, b[0] + part[xs].to_numpy() @ b[1:], rtol=1e-8)


def test_rolling_fit_with_a_graph_per_origin(spark, six, features):
    base = edges_of(spark, six).table
    edges = stage(base.withColumn("origin", F.explode(F.array(*[F.lit(o) for o in (30, 50, 70)]))), "edges")
    xs = graph.term_columns(["self", "six"], ["d"])
    a = backtest.rolling_graph_forecast(features, edges, ["d"], ["self", "six"], 30, 20, 25).toPandas()
    full = stage(graph.graph_panel(features, edges_of(spark, six), ["d"], ["self", "six"]), "full").table
    b = backtest.rolling_forecast(full, xs, 30, 20, 25).toPandas()
    key = ["pos", "ticker"]
    np.testing.assert_allclose(a.sort_values(key).yhat, b.sort_values(key).yhat, rtol=1e-9)


def test_planted_cross_lags(spark):
    x, rows = {"A": [1.0], "B": [2.0]}, []
    rng = np.random.default_rng(4)
    for p in range(60):
        for t in "AB":
            rows.append((DAY0 + dt.timedelta(days=p), p, t, x[t][-1]))
        a, b = x["A"][-1], x["B"][-1]
        x["A"].append(0.1 + 0.1 * a + 0.1 * b)
        x["B"].append(float(rng.uniform(1, 3)))
    dense = stage(spark.createDataFrame(rows, "date date, pos int, ticker string, value double"), "planted").table
    got = {r.term: (r.beta, r.r2) for r in control.cross_lag_report(dense, {"A": [("A", 1), ("B", 1)]}).collect()}
    for term in ("intercept", "A^1", "B^1"):
        assert got[term][0] == pytest.approx(0.1, abs=1e-8) and got[term][1] == pytest.approx(1)


def test_sparse_precision_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    s = np.cov((rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8))).T, ddof=0)
    for share in (0.02, 0.2):
        lam = share * np.abs(s - np.diag(np.diag(s))).max()
        p, _, ok = glasso.sparse_precision(s, lam, tol=1e-9, max_iter=20_000)
        assert ok and np.linalg.eigvalsh(p).min() > 0
        g = np.linalg.inv(p) - s  # zero on the diagonal, lam * sign where p <> 0, within lam elsewhere
        off = ~np.eye(8, dtype=bool)
        scale = np.abs(s).max()
        assert np.abs(np.diag(g)).max() < 1e-5 * scale
        assert np.allclose(g[off & (p != 0)], lam * np.sign(p[off & (p != 0)]), atol=1e-5 * scale)
        assert np.abs(g[off & (p == 0)]).max(initial=0) <= lam + 1e-5 * scale
    p, _, _ = glasso.sparse_precision(s, 10 * np.abs(s).max())
    assert (p[off] == 0).all()


def test_graph_estimate_finds_planted_links(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(250, 5))
    z[:, 1] += 0.9 * z[:, 0]
    z[:, 4] -= 0.9 * z[:, 3]
    rows = [(0, p, DAY0 + dt.timedelta(days=p), f"T{k}", float(v)) for p, r in enumerate(z) for k, v in enumerate(r)]
    rets = stage(spark.createDataFrame(rows, "origin int, pos int, date date, ticker string, ret double"), "rets").table
    edges = glasso.estimate_graph(rets).table
    found = {(r.src, r.dst) for r in edges.filter("src < dst").collect()}
    assert {("T0", "T1"), ("T3", "T4")} <= found
    assert edges.filter("src = dst").count() == 5 and edges.select("status").distinct().collect()[0][0] == "ok"
    sizes = glasso.fold_moments(rets.filter("pos < 13"), 5).table.select("fold", "n").distinct().orderBy("fold").collect()
    assert [r.n for r in sizes] == [3, 3, 3, 2, 2]


@pytest.mark.parametrize("model", list(gnn.MODELS))
@pytest.mark.parametrize("loss,head", [("mse", "softplus"), ("qlike", "softplus_shift"), ("qlike_floor", "relu")])
def test_gradients(model, loss, head):
    rng = np.random.default_rng(7)
    depth, rectify = gnn.MODELS[model]
    x, y, adj = rng.uniform(0.5, 2, (4, 5, 3)), rng.uniform(0.5, 2, (4, 5)), rng.uniform(0, 0.4, (5, 5))
    p = gnn._start(rng, 3, 4 if rectify else 1, depth)
    p[0][:] = np.abs(p[0])

    def value(q):
        f, slope, h, trace = gnn._forward(q, x, adj, depth, rectify, head)
        v, d = gnn._loss(loss, y, f)
        return v, gnn._gradients(q, x, adj, depth, rectify, d * slope, h, trace)

    _, g = value(p)
    for k in p:
        for at in np.ndindex(p[k].shape):
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert (value(up)[0] - value(down)[0]) / 2e-6 == pytest.approx(g[k][at], abs=1e-5)


def test_fits_and_scoring_agree(spark, six, features):
    """Weights fitted in a task and scored as join-aggregates reproduce the same forecasts."""
    spans = backtest.assign_origins(features, 60, 30, 50, 10).filter("part <> 'test'")
    links = graph.normalise(six).withColumn("origin", F.lit(60))
    runs = [{"name": m, "model": m, "graph": "six", "loss": "mse", "epochs": 40, "rate": 0.02, "batch": 16, "hidden": 4}
            for m in ("HAR", "GHAR", "GNN2L")]
    fits = gnn.fit_tournament(spans, links, ["d", "w", "m"], runs, [1, 2])
    again = gnn.fit_tournament(spans, links, ["d", "w", "m"], runs, [1, 2])
    key = ["run", "seed", "kind", "layer", "i", "j"]
    a, b = (f.table.toPandas().sort_values(key).value.to_numpy() for f in (fits, again))
    np.testing.assert_array_equal(a, b)
    h = gnn.fit_history(fits.table).toPandas()
    assert (h.groupby(["run", "seed"]).size() == 40).all()
    first, last = h[h.epoch == 0].train.mean(), h[h.epoch == 39].train.mean()
    assert last < first
    test = features.filter("pos >= 60").withColumn("origin", F.lit(60))
    x = test.toPandas().sort_values(["pos", "ticker"])
    cube, adj = x[["d", "w", "m"]].to_numpy().reshape(-1, 6, 3), matrix(graph.normalise(six))
    for run in runs:
        w = gnn.fit_weights(fits.table.filter((F.col("run") == run["name"]) & (F.col("seed") == 1)))
        packed = gnn.pack_weights(w, ["run", "origin", "seed"])
        got = gnn.score(test, edges_of(spark, six), packed, ["d", "w", "m"], run["model"], "six", 4, on=["run", "origin", "seed"])
        depth, rectify = gnn.MODELS[run["model"]]
        params = {}
        for layer, part in w.toPandas().groupby("layer"):
            part = part.sort_values(["i", "j"])
            params[layer] = part.value.to_numpy().reshape(part.i.nunique(), part.j.nunique())
        want, *_ = gnn._forward(params, cube, adj, depth, rectify, "relu")
        np.testing.assert_allclose(got.toPandas().sort_values(["pos", "ticker"]).yhat, want.ravel(), rtol=1e-8)


def test_restart_rule():
    assert gnn.needs_restart(np.array([5.0, 5.0, 5.0, 5.0]))
    assert gnn.needs_restart(np.array([1.0, 50.0, 101.0]))
    assert gnn.needs_restart(np.array([1.0, float("nan")]))
    assert not gnn.needs_restart(np.array([5.0, 4.0, 3.0, 3.0]))


def test_pseudo_series_keep_level_and_correlation(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=400)
    rows = [(DAY0 + dt.timedelta(days=p), p, 400, t, float(m + s * (0.8 * base[p] + 0.6 * rng.normal())))
            for p in range(400) for t, m, s in (("A", 5, 1), ("B", 9, 2))]
    df = stage(spark.createDataFrame(rows, "date date, pos int, n_dates int, ticker string, value double"), "series").table
    plain = control.pseudo_series(df, df, ["value"]).toPandas().pivot(index="date", columns="ticker", values="value")
    kept = control.correlated_pseudo_series(df, df, "value").toPandas().pivot(index="date", columns="ticker", values="value")
    real = df.toPandas().pivot(index="date", columns="ticker", values="value")
    for got in (plain, kept):
        np.testing.assert_allclose(got.mean(), real.mean(), atol=0.35)
        np.testing.assert_allclose(got.std(), real.std(), rtol=0.15)
    assert abs(np.corrcoef(plain.A, plain.B)[0, 1]) < 0.15
    assert np.corrcoef(kept.A, kept.B)[0, 1] == pytest.approx(np.corrcoef(real.A, real.B)[0, 1], abs=0.12)


def test_moments_keep_their_digits_at_large_levels(spark):
    """Mean 1e8, spread 1: fits, nested fits, fixed effects, rolling fits and covariances against centred arithmetic."""
    rng = np.random.default_rng(3)
    n_dates, names = 60, ["A", "B", "C"]
    x, z = rng.normal(size=(n_dates, 3)), rng.normal(size=(n_dates, 3))
    y = 2 * x - 0.5 * z + rng.normal(size=(n_dates, 3)) * 0.1
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), d, n_dates, name, float(1e8 + y[d, k]), float(1e8 + x[d, k]), float(-3e8 + z[d, k])) for d in range(n_dates) for k, name in enumerate(names)]
    df = spark.createDataFrame(rows, "date date, pos int, n_dates int, ticker string, target double, x double, z double").repartition(7)

    def slopes(keep, columns):  # the numbers as they are stored, centred before anything is multiplied
        cols = np.array([[r[5], r[6], r[4]] for r in rows if keep(r)])
        c = cols - cols.mean(0)
        return np.linalg.lstsq(c[:, columns], c[:, 2], rcond=None)[0]
    assert np.allclose(regress.fit_ols(df, ["x", "z"]).table.first().beta, slopes(lambda r: True, [0, 1]), rtol=1e-8)
    nested = {r.model: r.beta for r in regress.fit_nested(df, {"x": ["x"], "zx": ["z", "x"]}).table.collect()}
    assert np.allclose(nested["x"], slopes(lambda r: True, [0]), rtol=1e-8) and np.allclose(nested["zx"], slopes(lambda r: True, [1, 0]), rtol=1e-8)
    rolling = {r.origin: r.beta for r in backtest.rolling_ols(df, ["x", "z"], 20, 10, 15).table.collect()}
    assert set(rolling) == {20, 30, 40, 50}
    for o, beta in rolling.items():
        assert np.allclose(beta, slopes(lambda r: o - 15 <= r[1] < o, [0, 1]), rtol=1e-8)
    own = {name: np.array([[r[5], r[6], r[4]] for r in sorted(rows) if r[3] == name]) for name in names}
    within = np.concatenate([v - v.mean(0) for v in own.values()])
    assert np.allclose(regress.fit_fixed_effects(df, ["x", "z"])[0].table.first().beta, np.linalg.lstsq(within[:, :2], within[:, 2], rcond=None)[0], rtol=1e-8)
    cov = {(r.src, r.dst): r.cov for r in graph.covariances(graph.cross_moments(df, "x", [], block=2, chunk=7)).collect()}
    want = np.cov(np.array([own[name][:, 0] for name in names]), bias=True)
    assert all(cov[a, b] == pytest.approx(want[i, j], rel=1e-8, abs=1e-8) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)


def test_cross_lags_of_many_targets_match_single_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(d, d, t, float(1 + rng.normal() ** 2) if not (t == "C" and d in (0, 5, 6)) else None) for d in range(40) for t in "ABC"]
    df = spark.createDataFrame(rows, "date int, pos int, ticker string, value double")
    specs = {"A": [("A", 1), ("B", 1), ("B", 2)], "B": [("C", 1)], "C": [("C", 1), ("A", 2)]}
    got = {(r.target, r.term): (r.beta, r.r2) for r in control.cross_lag_report(df, specs).collect()}
    assert len(got) == 9
    for target, regs in specs.items():
        coef, fit = control.cross_lag_check(df, target, regs)
        one, r2 = coef.table.first(), fit.first().r2
        terms = ["intercept", *[f"{t}^{p}" for t, p in regs]]
        assert [got[target, t][0] for t in terms] == pytest.approx([one.intercept, *one.beta]) and [got[target, t][1] for t in terms] == pytest.approx([r2] * len(terms))


def skips(seed, i, n, density):
    """The partners of one node by the keyed skips, one after another."""
    out, j, k = [], i, 0
    while True:
        u = (int(hashlib.md5(f"{seed}:{i}:{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32
        j += 1 + int(np.floor(np.log(u) / np.log1p(-density)))
        if j >= n:
            return out
        out.append(j)
        k += 1


@pytest.mark.parametrize("n,density", [(2, 0.5), (40, 0.3), (40, 0.97), (300, 0.01)])
def test_sparse_random_graphs_draw_the_skips(spark, n, density):
    nodes = graph.number_nodes(spark.range(n).select(F.format_string("n%04d", "id").alias("ticker")))
    got = graph.sparse_random_edges(nodes, [3, 4], density).collect()
    half = sorted((r.graph, int(r.src[1:]), int(r.dst[1:])) for r in got if r.src < r.dst)
    assert half == sorted((f"random_{s}", i, j) for s in (3, 4) for i in range(n) for j in skips(s, i, n, density))
    assert len(got) == 2 * len(half) and {(r.graph, r.dst, r.src) for r in got} == {(r.graph, r.src, r.dst) for r in got}


def test_sparse_random_graphs_follow_the_law(spark):
    """Every pair is present with the same probability, whatever its place; and many nodes cost as their edges do."""
    nodes = graph.number_nodes(spark.range(8).select(F.format_string("n%d", "id").alias("ticker")))
    runs = 600
    got = graph.sparse_random_edges(nodes, list(range(runs)), 0.3).where("src < dst").groupBy("src", "dst").count().collect()
    share = np.array([r["count"] for r in got]) / runs
    assert len(share) == 28 and abs(share.mean() - 0.3) < 0.01 and np.abs(share - 0.3).max() < 4 * np.sqrt(0.21 / runs)
    many = graph.number_nodes(spark.range(100_000).select(F.format_string("n%06d", "id").alias("ticker")))
    edges = graph.sparse_random_edges(many, [1], 1e-4)
    n, ends = edges.count() / 2, edges.select("src").distinct().count()
    assert abs(n / (100_000 * 99_999 / 2 * 1e-4) - 1) < 0.01 and ends > 99_000
    with pytest.raises(ValueError, match="density"):
        graph.sparse_random_edges(many, [1], 0.0)


@pytest.mark.parametrize("size", [1, 3, 4, 100])
def test_bucketed_tensors(spark, size):
    """Ten tickers, some without rows on some dates; arrays never outgrow a bucket and come back to the same rows."""
    rng = np.random.default_rng(8)
    rows = [(o, d, d, f"t{k}", float(rng.normal()) if rng.random() < 0.9 else None, float(k), float(d)) for o in (1, 2) for d in range(6) for k in range(10) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "origin int, date int, pos int, ticker string, a double, b double, target double").repartition(5)
    nodes = graph.number_nodes(df)
    got = gnn.bucket_tensors(df, nodes, ["a", "b"], ["origin"], size)
    names = sorted({r[3] for r in rows})
    cells = {(r[0], r[1], r[3]): r for r in rows}
    collected = got.collect()
    assert len(collected) == 12 * -(-len(names) // size)
    for r in collected:
        here = names[r.bucket * size:(r.bucket + 1) * size]
        assert len(r.x) == len(r.y) == len(r.present) == len(here)
        for name, x, y, present in zip(here, r.x, r.y, r.present):
            cell = cells.get((r.origin, r.date, name))
            assert present == (cell is not None) and (x, y) == (([cell[4] or 0.0, cell[5]], cell[6]) if cell else ([0.0, 0.0], 0.0))
    back = gnn.label_buckets(got.select("origin", "date", "bucket", "present", F.transform("x", lambda v: v[1]).alias("yhat")), nodes, ["origin", "date"], size).collect()
    assert sorted((r.origin, r.date, r.ticker, r.yhat) for r in back) == sorted((r[0], r[1], r[3], r[5]) for r in rows)


def test_factor_pseudo_series_correlate_by_their_loadings(spark):
    rng = np.random.default_rng(12)
    common = rng.normal(size=3000)
    load = {"A": 0.9, "B": 0.8, "C": -0.7, "D": 0.0}
    rows = [(d, t, float(5 + 2 * (v * common[d] + np.sqrt(1 - v * v) * rng.normal()))) for t, v in load.items() for d in range(3000)] + [(d, "E", 1.5) for d in range(3000)]
    df = spark.createDataFrame(rows, "date int, ticker string, value double")
    got = control.factor_pseudo_series(df, df, "value").toPandas().pivot(index="date", columns="ticker", values="value")
    real = df.toPandas().pivot(index="date", columns="ticker", values="value")
    found = {t: np.corrcoef(real[t], real.mean(axis=1))[0, 1] for t in load}
    assert (got.E == 1.5).all() and all(got[t].mean() == pytest.approx(real[t].mean(), abs=0.15) and got[t].std() == pytest.approx(real[t].std(), rel=0.1) for t in load)
    for a, b in (("A", "B"), ("A", "C"), ("B", "D")):
        assert np.corrcoef(got[a], got[b])[0, 1] == pytest.approx(found[a] * found[b], abs=0.06)


def test_node_grid(spark):
    nodes = graph.number_nodes(spark.createDataFrame([("a",), ("b",), ("c",)], "ticker string"))
    assert sorted(map(tuple, graph.node_grid(nodes, "g").collect())) == [("g", x, y) for x in "abc" for y in "abc"]


def test_sparse_random_graphs_shuffle_no_edges(spark, monkeypatch):
    """Neither names nor degrees move the edges; with degrees beyond the limit the weights are the same."""
    monkeypatch.setattr(graph, "DRAWS", 500, raising=False)
    nodes = graph.number_nodes(spark.range(200).select(F.format_string("n%04d", "id").alias("ticker")))
    edges = graph.sparse_random_edges(nodes, [3, 4], 0.1)
    weighted = graph.normalise(edges)
    assert "Exchange hashpartitioning" not in weighted._jdf.queryExecution().executedPlan().toString()
    rows = {(r.graph, r.src, r.dst): r.w for r in weighted.collect()}
    degree = {(r.graph, r.src): r["count"] for r in edges.groupBy("graph", "src").count().collect()}
    assert len(rows) == sum(degree.values()) and all(w == pytest.approx(1 / np.sqrt((degree[g, a] + 1e-8) * (degree[g, b] + 1e-8))) for (g, a, b), w in rows.items())
    monkeypatch.setattr(graph, "DEGREE_ROWS", 1, raising=False)
    assert {(r.graph, r.src, r.dst): r.w for r in graph.normalise(edges).collect()} == rows
