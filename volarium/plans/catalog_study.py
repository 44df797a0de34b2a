"""Queries: graph studies, controls, cross-lag checks and graph-network forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from volarium.functions.scalars import keyed_uniform, rounded
from volarium.operators import backtest, control, evaluate, gnn, graph, har, panel, regress
from volarium.plans import catalog_graph as cg
from volarium.plans import catalog_model as cm
from volarium.plans import sqlkit as q
from volarium.plans import tables as t
from volarium.plans.registry import query
from volarium.session import Staged, attach, stage

X3, X6, IDS, TRAIN = cm.X3, cm.X6, cm.IDS, cm.TRAIN
DENSITIES = {0: 0.15, 1: 0.3, 2: 0.5, 3: 0.75}
DATE = "CAST(date AS VARCHAR) AS date"


def study_edges(nodes):
    """Ring and random graphs of several densities, each run with its own identity term."""
    ring = graph.edges_from_list(graph.ring_pairs(nodes, 2), "ring")
    control_graphs = graph.random_edges(nodes, "bernoulli", list(DENSITIES), list(DENSITIES.values()))
    runs = graph.normalise(stage(ring.unionByName(control_graphs), "runs").table)
    names = F.array(F.lit("ring"), *[F.lit(f"random_{s}") for s in DENSITIES])
    own = graph.identity_edges(nodes.table).withColumn("run", F.explode(names))
    links = runs.select(F.col("graph").alias("run"), F.lit("g").alias("graph"), "src", "dst", "w")
    return stage(own.unionByName(links), "edges")


STUDY_SQL = f"""WITH {q.nation_dense()}, {q.features('nested')}, {q.ring('features', 2)},
nodes AS (SELECT DISTINCT ticker FROM features),
dens AS (SELECT unnest([{', '.join(map(str, DENSITIES))}]) AS seed, unnest([{', '.join(map(repr, DENSITIES.values()))}]) AS p),
upper AS (SELECT seed, p, a.ticker AS src, b.ticker AS dst, {q.uniform('seed', 'a.ticker', 'b.ticker')} AS u FROM nodes a, nodes b, dens WHERE a.ticker < b.ticker),
rlinks AS (SELECT 'random_' || seed AS run, src, dst FROM upper WHERE u < p UNION ALL SELECT 'random_' || seed, dst, src FROM upper WHERE u < p),
rdeg AS (SELECT run, src, count(*) AS degree FROM rlinks GROUP BY 1, 2),
edges AS (SELECT 'ring' AS run, src, dst, w FROM ring UNION ALL
  SELECT l.run, l.src, l.dst, 1 / sqrt((a.degree + 1e-8) * (b.degree + 1e-8)) FROM rlinks l
  JOIN rdeg a ON a.run = l.run AND a.src = l.src JOIN rdeg b ON b.run = l.run AND b.src = l.dst),
runfeat AS (SELECT run, f.* FROM features f, (SELECT DISTINCT run FROM edges)),
{q.graph_features(X3, edges='edges', source='runfeat', on=['run'])},
{q.ols('gfeat', cm.GX3, 'target', [*IDS, 'run'], TRAIN, 'fit', by=['run'])},
scores AS (SELECT run, {q.MSE} AS mse FROM fit WHERE NOT tr GROUP BY 1),
dense_of AS (SELECT run, count(*) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0)) AS density FROM edges GROUP BY 1),
study AS (SELECT run, mse, density FROM scores JOIN dense_of USING (run))
SELECT run, round(mse, 6) + 0.0 AS mse, round(density, 6) + 0.0 AS density, CAST(rank() OVER (ORDER BY mse) AS BIGINT) AS place,
  round(corr(density, mse) OVER (), 5) + 0.0 AS density_corr, round((max(mse) OVER () - mse) / max(mse) OVER () * 100, 5) + 0.0 AS mse_improvement FROM study"""


@query("M16 M8 M4 M6 A10 W11 A11 A13", STUDY_SQL)
def graph_study(spark, sf):
    """One regression per graph, all graphs in one job keyed by run."""
    feats = t.nation_features(spark, sf).table
    names = graph.number_nodes(feats)
    edges = study_edges(names)
    rows = stage(graph.graph_panel(feats, edges, X3, ["self", "g"], runs=["run"]), "study-panel").table
    xs = graph.term_columns(["self", "g"], X3)
    train, test = panel.split_by_fraction(rows, 0.7)
    pred = regress.predict(test, regress.fit_ols(train, xs, by=["run"]), xs, ["run"])
    scores = evaluate.loss_table(pred, ["run"]).withColumnRenamed("run", "model")
    links = edges.table.filter("graph = 'g'").select(F.col("run").alias("graph"), "src", "dst", "w")
    both = stage(scores.join(graph.density(links, names.rows).withColumnRenamed("graph", "model"), "model"), "study").table
    table = evaluate.place(evaluate.improvement(both, "worst"), "mse", "place")
    out = table.withColumn("density_corr", both.agg(F.corr("density", "mse").alias("c")).scalar())
    return out.select(F.col("model").alias("run"), rounded("mse", 6).alias("mse"), rounded("density", 6).alias("density"),
                      F.col("place").cast("long").alias("place"), rounded("density_corr", 5).alias("density_corr"),
                      rounded("mse_improvement", 5).alias("mse_improvement"))


PSEUDO = f"""levels AS (SELECT ticker, avg(exog) AS mu, stddev_samp(exog) AS sd FROM dense WHERE {TRAIN} GROUP BY 1),
pseudo AS (SELECT ticker, date, pos, n_dates, value, mu + sd * {q.normal("'123-exog'", 'ticker', 'date')} AS exog FROM dense JOIN levels USING (ticker))"""


def pseudo_dense(spark, sf):
    dense = stage(t.dense_nations(spark, sf), "dense").table
    train, _ = panel.split_by_fraction(dense, 0.7)
    return control.pseudo_series(dense, train, ["exog"])


@query("M22", f"""WITH {q.nation_dense()}, {PSEUDO}
SELECT ticker, {DATE}, round(exog, 6) + 0.0 AS exog FROM pseudo""")
def pseudo_input(spark, sf):
    return pseudo_dense(spark, sf).select("ticker", t.text_date(), rounded("exog", 6).alias("exog"))


@query("M22", f"""WITH {q.nation_dense()}, {q.features('nested', exog=True)},
levels AS (SELECT ticker, {', '.join(f'avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}' for c in X6[3:])} FROM features WHERE {TRAIN} GROUP BY 1)
SELECT ticker, {DATE}, {', '.join(f"round(mu_{c} + sd_{c} * " + q.normal(f"'123-{c}'", 'ticker', 'date') + f", 6) + 0.0 AS {c}" for c in X6[3:])}
FROM features JOIN levels USING (ticker)""")
def pseudo_components(spark, sf):
    feats = t.nation_features(spark, sf, exog="exog").table
    out = control.pseudo_series(feats, panel.split_by_fraction(feats, 0.7)[0], X6[3:])
    return out.select("ticker", t.text_date(), *[rounded(c, 6).alias(c) for c in X6[3:]])


@query("M22 A11", f"""WITH {q.nation_dense()}, market AS (SELECT date, avg(exog) AS market FROM dense WHERE {TRAIN} GROUP BY 1),
levels AS (SELECT ticker, avg(exog) AS mu, stddev_samp(exog) AS sd, corr(exog, market) AS c FROM dense JOIN market USING (date) WHERE {TRAIN} GROUP BY 1)
SELECT ticker, {DATE}, round(mu + sd * (c * {q.normal("'123-exog-factor'", 'date')} + sqrt(1 - c * c) * {q.normal("'123-exog'", 'ticker', 'date')}), 6) + 0.0 AS exog
FROM dense JOIN levels USING (ticker)""")
def pseudo_input_factor(spark, sf):
    """Stand-in input whose tickers move together through one factor."""
    dense = stage(t.dense_nations(spark, sf), "dense").table
    out = control.factor_pseudo_series(dense, panel.split_by_fraction(dense, 0.7)[0], "exog")
    return out.select("ticker", t.text_date(), rounded("exog", 6).alias("exog"))


@query("M22 A11")
def pseudo_input_correlated(spark, sf):
    dense = stage(t.dense_nations(spark, sf).dropna("any", subset=["exog"]), "dense").table
    whole = stage(panel.complete_dates(dense, "exog"), "whole").table
    out = control.correlated_pseudo_series(whole, panel.split_by_fraction(whole, 0.7)[0], "exog")
    return out.select(t.text_date(), "ticker", "exog")


EFFECT_SQL = f"""WITH {q.nation_dense()}, {PSEUDO},
{q.features('nested', exog=True, out='real')}, {q.features('nested', exog=True, source='pseudo', out='fake')},
{q.ols('real', X3, 'target', IDS, TRAIN, 'fa')},
{q.ols('fake', X6, 'target', IDS, TRAIN, 'fb')},
{q.ols('real', X6, 'target', IDS, TRAIN, 'fc')},
l AS (SELECT (SELECT {q.MSE} FROM fa WHERE NOT tr) AS base, (SELECT {q.MSE} FROM fb WHERE NOT tr) AS control, (SELECT {q.MSE} FROM fc WHERE NOT tr) AS "full")"""


@query("M23 M22", EFFECT_SQL + """
SELECT round(base, 6) + 0.0 AS base, round(control, 6) + 0.0 AS control, round("full", 6) + 0.0 AS "full", round((base - "full") / base * 100, 5) + 0.0 AS total_effect,
  round((base - control) / base * 100, 5) + 0.0 AS parameter_effect, round((control - "full") / base * 100, 5) + 0.0 AS information_effect FROM l""")
def effect_decomposition(spark, sf):
    """Gain of a second input split into extra parameters (Gaussian stand-in) and information."""
    real = stage(har.har_panel(t.dense_nations(spark, sf), exog="exog"), "real").table
    fake = stage(har.har_panel(pseudo_dense(spark, sf), exog="exog"), "fake").table
    out = cm.nested_forecasts(real, {"HAR": X3, "HAR+IV": X6}, ["target"]).unionByName(
        cm.nested_forecasts(fake, {"HAR+pseudo": X6}, ["target"]))
    table = evaluate.effect_decomposition(evaluate.loss_table(out, ["model"]), "HAR", "HAR+pseudo", "HAR+IV")
    return table.select(*[rounded(c, 6).alias(c) for c in ("base", "control", "full")],
                        *[rounded(c, 5).alias(c) for c in ("total_effect", "parameter_effect", "information_effect")])


@query("M24", f"""WITH {q.nation_dense()}, {q.features('nested')}, {q.LAG_FORECASTS},
r AS (SELECT r_name AS region, model, target, yhat FROM pred JOIN nation ON n_name = ticker JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT region, model, {q.MSE} AS mse FROM r GROUP BY 1, 2)
SELECT a.region, round(a.mse, 6) + 0.0 AS base, round(b.mse, 6) + 0.0 AS better, round((a.mse - b.mse) / a.mse * 100, 5) + 0.0 AS gain
FROM s a JOIN s b ON a.region = b.region AND a.model = 'DAY' AND b.model = 'MONTH'""")
def relative_gain(spark, sf):
    n = t.read(spark, sf, "nation").join(t.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("ticker"), F.col("r_name").alias("region"))
    losses = evaluate.loss_table(t.lag_forecasts(t.nation_features(spark, sf).table).join(n, "ticker"), ["model", "region"])
    g = evaluate.relative_gain(losses, "MONTH", "DAY", ["region"])
    return g.select("region", rounded("base", 6).alias("base"), rounded("better", 6).alias("better"), rounded("gain", 5).alias("gain"))


SPECS = {"NATION_9": [("NATION_9", 1), ("NATION_6", 1), ("NATION_9", 2)],
         "NATION_7": [("NATION_7", 1), ("NATION_18", 1), ("NATION_14", 2)],
         "NATION_6": [("NATION_6", 1), ("NATION_16", 1)]}


def _spec_sql(k, target, regs):
    cols = ", ".join(f"max(CASE WHEN ticker = '{n}' THEN pow(lag1, {p}) END) AS x{i}" for i, (n, p) in enumerate(regs))
    xs = [f"x{i}" for i in range(len(regs))]
    known = " AND ".join(f"{c} IS NOT NULL" for c in ["target", *xs])
    return f"""s{k} AS (SELECT * FROM (SELECT date, max(CASE WHEN ticker = '{target}' THEN value END) AS target, {cols} FROM lagged GROUP BY 1) WHERE {known}),
{q.ols(f's{k}', xs, 'target', ['date'], 'true', f'fit{k}')},
o{k} AS (SELECT '{target}' AS target, {len(regs) + 1} AS n_terms, round(1 - sum(pow(target - yhat, 2)) / (var_pop(target) * count(*)), 6) + 0.0 AS r2 FROM fit{k})"""


@query("M25 A18 W2", f"WITH {q.nation_dense()}, lagged AS (SELECT *, lag(value) OVER (PARTITION BY ticker ORDER BY pos) AS lag1 FROM dense),\n"
       + ",\n".join(_spec_sql(k, target, regs) for k, (target, regs) in enumerate(SPECS.items()))
       + "\n" + " UNION ALL ".join(f"SELECT target, CAST(n_terms AS BIGINT) AS n_terms, r2 FROM o{k}" for k in range(len(SPECS))))
def cross_lag_fit(spark, sf):
    dense = stage(t.dense_nations(spark, sf).select("date", "pos", "ticker", "value"), "dense").table
    report = control.cross_lag_report(dense, SPECS)
    return report.groupBy("target").agg(F.count(F.lit(1)).alias("n_terms"), rounded(F.max("r2"), 6).alias("r2"))


@query("M25 M1", f"""WITH {q.nation_dense()}, lagged AS (SELECT *, lag(value) OVER (PARTITION BY ticker ORDER BY pos) AS lag1 FROM dense),
s AS (SELECT date, max(CASE WHEN ticker = 'NATION_6' THEN value END) AS y, max(CASE WHEN ticker = 'NATION_6' THEN lag1 END) AS a,
  max(CASE WHEN ticker = 'NATION_16' THEN lag1 END) AS b FROM lagged GROUP BY 1),
c AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my
  FROM s WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
k AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2, * FROM c)
SELECT 'NATION_6^1' AS term, round(b1, 6) + 0.0 AS beta FROM k UNION ALL SELECT 'NATION_16^1', round(b2, 6) + 0.0 FROM k
UNION ALL SELECT 'intercept', round(my - b1 * ma - b2 * mb, 6) + 0.0 FROM k""")
def cross_lag_coefficients(spark, sf):
    dense = stage(t.dense_nations(spark, sf).select("date", "pos", "ticker", "value"), "dense").table
    return control.cross_lag_report(dense, {"NATION_6": SPECS["NATION_6"]}).select("term", rounded("beta", 6).alias("beta"))


HID = 3


def _weight_rows(model):
    """(layer, i, j) of a model's weights with 3 inputs and 3 hidden units."""
    depth, rectify = gnn.MODELS[model]
    width = HID if rectify else 1
    rows = [(0, i, 0) for i in range(-1, 3)]
    size = 3
    for layer in range(1, depth + 1):
        rows += [(layer, i, j) for i in range(-1, size) for j in range(width)]
        size = width
    return rows + ([(depth + 1, i, 0) for i in range(width)] if depth else [])


HEAD_SQL = {"relu": "greatest({0}, 0.0)", "softplus": "greatest({0}, 0.0) + ln(1 + exp(-abs({0})))",
            "softplus_shift": "greatest({0}, 0.0) + ln(1 + exp(-abs({0}))) + 1e-6"}


def _score_sql(model, head):
    depth, rectify = gnn.MODELS[model]
    width = HID if rectify else 1
    cells = [f"({layer}, {i}, {j})" for layer, i, j in _weight_rows(model)]
    name = lambda layer, i, j: f"p{layer}_{i + 1}_{j}"
    pivot = ", ".join(f"max(CASE WHEN layer = {l} AND i = {i} AND j = {j} THEN v END) AS {name(l, i, j)}" for l, i, j in _weight_rows(model))
    ctes = [f"""wcells(layer, i, j) AS (VALUES {', '.join(cells)}),
weights AS (SELECT run, layer, i, j, {q.uniform('run', 'layer', 'i', 'j')} - 0.4 AS v FROM wcells, (VALUES ('a'), ('b')) r(run)),
wide AS (SELECT run, {pivot} FROM weights GROUP BY 1),
h0 AS (SELECT run, date, ticker, {name(0, -1, 0)} + {' + '.join(f'{c} * {name(0, i, 0)}' for i, c in enumerate(X3))} AS own, {', '.join(f'{c} AS h{i}' for i, c in enumerate(X3))} FROM features, wide)"""]
    size = 3
    for layer in range(1, depth + 1):
        z = ", ".join(f"{' + '.join(f'h{i} * {name(layer, i, j)}' for i in range(size))} AS z{j}" for j in range(width))
        bias = [name(layer, -1, j) for j in range(width)]
        act = (lambda e: f"greatest({e}, 0.0)") if rectify else (lambda e: e)
        hs = ", ".join(act(f"coalesce(z{j}, 0) + {bias[j]}") + f" AS h{j}" for j in range(width))
        ctes.append(f"""z{layer} AS (SELECT run, date, ticker, own, {z} FROM h{layer - 1} JOIN wide USING (run)),
n{layer} AS (SELECT run, date, dst AS ticker, {', '.join(f'sum(ring.w * z{j}) AS z{j}' for j in range(width))} FROM z{layer} JOIN ring ON src = ticker GROUP BY ALL),
h{layer} AS (SELECT a.run, a.date, a.ticker, a.own, {hs} FROM z{layer} a LEFT JOIN
  (SELECT run, date, ticker, {', '.join(f'z{j} AS y{j}' for j in range(width))} FROM n{layer}) n USING (run, date, ticker) JOIN wide ON wide.run = a.run)""".replace("coalesce(z", "coalesce(y"))
        size = width
    tail = f" + {' + '.join(f'h{i} * {name(depth + 1, i, 0)}' for i in range(size))}" if depth else ""
    raw = f"(own{tail})"
    return f"""WITH {q.nation_dense()}, {q.features('nested')}, {q.ring('features', 2)}, {', '.join(ctes)}
SELECT run, CAST(date AS VARCHAR) AS date, ticker, round({HEAD_SQL[head].format(raw)}, 6) + 0.0 AS yhat FROM h{depth} JOIN wide USING (run)"""


def _score(spark, sf, model, head):
    feats = t.nation_features(spark, sf).table
    cells = F.array(*[F.struct(F.lit(l).alias("layer"), F.lit(i).alias("i"), F.lit(j).alias("j")) for l, i, j in _weight_rows(model)])
    rows = spark.createDataFrame([("a",), ("b",)], "run string").withColumn("c", F.explode(cells)).select("run", "c.*")
    weights = gnn.pack_weights(rows.withColumn("value", keyed_uniform("run", "layer", "i", "j") - 0.4))
    out = gnn.score(feats, t.ring_graph(feats), weights, X3, model, "ring", HID, head)
    return out.select("run", t.text_date(), "ticker", rounded("yhat", 6).alias("yhat"))


@query("M11", _score_sql("HAR", "relu"))
def score_har(spark, sf):
    return _score(spark, sf, "HAR", "relu")


@query("M11", _score_sql("GHAR", "softplus"))
def score_ghar(spark, sf):
    return _score(spark, sf, "GHAR", "softplus")


@query("M11", _score_sql("GNN1L", "relu"))
def score_gnn_1l(spark, sf):
    return _score(spark, sf, "GNN1L", "relu")


@query("M11", _score_sql("GNN2L", "softplus"))
def score_gnn_2l(spark, sf):
    return _score(spark, sf, "GNN2L", "softplus")


@query("M11", _score_sql("GNN3L", "softplus_shift"))
def score_gnn_3l(spark, sf):
    return _score(spark, sf, "GNN3L", "softplus_shift")


# A history has one step a week and a loss that repeats in weeks without shipments: the supplier's filled value, from its first week on.
HISTORY = f"""{q.SUPPLIER_DENSE}, history AS (SELECT ticker, pos AS epoch, value * 40 AS valid FROM dense WHERE value IS NOT NULL)"""


def histories(spark, sf):
    dense = t.dense_suppliers(spark, sf).filter("value IS NOT NULL")
    return stage(dense.select("ticker", F.col("pos").alias("epoch"), (F.col("value") * 40).alias("valid")), "histories").table


@query("W14", f"""WITH {HISTORY}, b AS (SELECT ticker, epoch, valid, min(valid) OVER w AS best, arg_min(epoch, valid) OVER w AS best_epoch
  FROM history WINDOW w AS (PARTITION BY ticker ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT ticker, epoch, round(valid, 6) + 0.0 AS valid, round(best, 6) + 0.0 AS best_loss, best_epoch AS best_step FROM b""")
def best_epochs(spark, sf):
    """The running best step of every history."""
    out = evaluate.best_so_far(histories(spark, sf), ["ticker"])
    return out.select("ticker", F.col("epoch").cast("long").alias("epoch"), rounded("valid", 6).alias("valid"), rounded("best_loss", 6).alias("best_loss"), F.col("best_step").cast("long").alias("best_step"))


@query("M13 W13 W14", f"""WITH {HISTORY}, s AS (SELECT *, abs(valid - lag(valid) OVER w) < 1e-6 AS flat, row_number() OVER w AS place FROM history WINDOW w AS (PARTITION BY ticker ORDER BY epoch)),
islands AS (SELECT ticker, count(*) AS steps FROM (SELECT ticker, place - row_number() OVER (PARTITION BY ticker ORDER BY epoch) AS island FROM s WHERE flat) GROUP BY ticker, island),
f AS (SELECT ticker, avg(CASE WHEN flat THEN 1.0 ELSE 0.0 END) AS flat_share, arg_max(valid, epoch) AS final_loss, min(valid) AS best_loss, arg_min(epoch, valid) AS best_step FROM s GROUP BY 1)
SELECT ticker, round(flat_share, 6) + 0.0 AS flat_share, CAST(coalesce((SELECT max(steps) FROM islands i WHERE i.ticker = f.ticker), 0) AS BIGINT) AS longest_flat,
  round(final_loss, 6) + 0.0 AS final_loss, CAST(best_step AS BIGINT) AS best_step, round(best_loss, 6) + 0.0 AS best_loss, flat_share > 0.5 OR final_loss > 100 AS restart FROM f""")
def restart_rule(spark, sf):
    """Which histories stand still for more than half of their steps or end too high."""
    out = evaluate.restart_rule(histories(spark, sf), ["ticker"])
    return out.select("ticker", rounded("flat_share", 6).alias("flat_share"), F.col("longest_flat").cast("long").alias("longest_flat"), rounded("final_loss", 6).alias("final_loss"),
                      F.col("best_step").cast("long").alias("best_step"), rounded("best_loss", 6).alias("best_loss"), "restart")


RUNS = [{"name": "HAR_mse", "model": "HAR", "graph": "ring", "loss": "mse"},
        {"name": "GNN1L_mse", "model": "GNN1L", "graph": "ring", "loss": "mse"},
        {"name": "GNN2L_qlike", "model": "GNN2L", "graph": "ring", "loss": "qlike", "head": "softplus"},
        {"name": "GNN2L_bare", "model": "GNN2L", "graph": "ring", "loss": "qlike_floor", "head": "softplus", "own": False,
         "layer_bias": True, "clip": 5.0}]
FIRST, STEP, LOOK = 200, 44, 150


def fitted(spark, sf, epochs=80):
    """Fits of every (origin, run, seed) on the weekly nation panel; returns (features, edges, fits)."""
    feats = stage(backtest.renumber(t.nation_features(spark, sf).table), "weekly").table
    edges = t.ring_graph(feats)
    spans = backtest.assign_origins(feats, FIRST, STEP, LOOK).filter("part <> 'test'")
    origins = spans.select("origin").distinct().agg(F.collect_list("origin").alias("o")).scalar()
    links = edges.table.filter("graph = 'ring'").withColumn("origin", F.explode(origins))
    runs = [{**r, "epochs": epochs, "rate": 0.01, "batch": 64} for r in RUNS]
    return feats, edges, gnn.fit_tournament(spans, links, X3, runs, seeds=(1, 2, 3))


@query("M12 M13 M15 W14 S7 J7")
def network_fits(spark, sf):
    """Loss history of every fit and the epoch whose weights were kept."""
    _, _, fits = fitted(spark, sf)
    h = gnn.fit_history(fits.table)
    kept = h.groupBy("run", "origin", "seed").agg(
        F.count(F.lit(1)).alias("n_epochs"), F.min_by("epoch", "valid").alias("best_epoch"), F.min("valid").alias("best_valid"),
        F.max_by("train", "epoch").alias("final_train"), F.max_by("valid", "epoch").alias("final_valid"))
    flat = evaluate.flat_share(h, ["run", "origin", "seed"]).select("run", "origin", "seed", "flat_share")
    return kept.join(flat, ["run", "origin", "seed"])


@query("M11 M12 M14 A21 A5 A6 J7")
def network_tournament(spark, sf):
    """Fit, screen the seeds by validation loss, score as join-aggregates, average, and compare."""
    feats, edges, fits = fitted(spark, sf)
    losses = gnn.fit_history(fits.table).groupBy("run", "origin", "seed").agg(F.max_by("valid", "epoch").alias("valid_loss"))
    kept = stage(evaluate.screen_ensemble(losses).select("run", "origin", "seed"), "kept").table
    weights = stage(gnn.fit_weights(fits.table).join(kept, ["run", "origin", "seed"], "left_semi"), "weights").table
    test = stage(backtest.test_rows(feats, FIRST, STEP), "test").table
    out = None
    for run in RUNS:
        packed = gnn.pack_weights(weights.filter(F.col("run") == run["name"]), ["run", "origin", "seed"])
        seeds = packed.table.select("run", "origin", "seed")
        members = attach(test, Staged(seeds, packed.rows), ["origin"])
        part = gnn.score(members, edges, packed, X3, run["model"], "ring", head=run.get("head", "relu"), on=["run", "origin", "seed"])
        out = part if out is None else out.unionByName(part)
    mean = out.groupBy("run", "origin", "date", "ticker").agg(F.avg("yhat").alias("yhat"), F.max("target").alias("target"))
    return evaluate.loss_table(mean.withColumnRenamed("run", "model"), ["model"], eps_pred=1e-6)
