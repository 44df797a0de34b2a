"""Queries: least squares, fixed-split and rolling forecasts, forecast repair and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from volarium.functions.scalars import rounded
from volarium.operators import backtest, evaluate, glasso, graph, har, panel, regress
from volarium.plans import catalog_graph as cg
from volarium.plans import sqlkit as q
from volarium.plans import tables as t
from volarium.plans.registry import query
from volarium.session import Staged, scratch_path, stage
from volarium.sources import scans, sinks

X3 = ["d", "w", "m"]
X6 = [*X3, "iv_d", "iv_w", "iv_m"]
IDS = ["date", "ticker", "pos", "n_dates"]
TRAIN = "pos < floor(n_dates * 0.7)"
DATE = "CAST(date AS VARCHAR) AS date"


def split(feats):
    return panel.split_by_fraction(feats, 0.7)


def fixed_split_forecast(feats, xs):
    """OLS on the first 70 % of the dates, forecasts for the rest."""
    train, test = split(feats)
    return regress.predict(test, regress.fit_ols(train, xs), xs)


@query("M4 A7 J8 W8 W3 P7 M1 M2 A5 A6", f"""WITH {q.SUPPLIER_DENSE}, {q.features('nested')},
{q.ols('features', X3, 'target', IDS, TRAIN, 'fit')},
pred AS (SELECT * FROM fit WHERE NOT tr)
SELECT ticker, round({q.MSE}, 6) + 0.0 AS mse, round({q.QLIKE}, 6) + 0.0 AS qlike, count(*) AS n FROM pred GROUP BY 1""")
def har_forecast_losses(spark, sf):
    pred = fixed_split_forecast(t.supplier_features(spark, sf).table, X3)
    return pred.groupBy("ticker").agg(*[rounded(c, 6).alias(n) for n, c in evaluate.loss_columns().items()],
                                      F.count(F.lit(1)).alias("n"))


def _det(a, b, c, d, e, f, g, h, i):
    return f"(({a})*(({e})*({i})-({f})*({h})) - ({b})*(({d})*({i})-({f})*({g})) + ({c})*(({d})*({h})-({e})*({g})))"


def _cramer():
    s = lambda x, y: f"s_{min(x, y)}{max(x, y)}"
    m = [s(a, b) for a in "dmw" for b in "dmw"]
    r = [f"c_{x}" for x in "dmw"]
    out = []
    for k in range(3):
        col = [r[i] if j == k else m[i * 3 + j] for i in range(3) for j in range(3)]
        out.append(f"{_det(*col)} / {_det(*m)}")
    return out


@query("M1", f"""WITH {q.SUPPLIER_DENSE}, {q.features('nested')},
mom AS (SELECT count(*) AS n, avg(target) AS y0, avg(d) AS d0, avg(w) AS w0, avg(m) AS m0,
  covar_pop(d, d) AS s_dd, covar_pop(d, m) AS s_dm, covar_pop(d, w) AS s_dw, covar_pop(m, m) AS s_mm, covar_pop(m, w) AS s_mw,
  covar_pop(w, w) AS s_ww, covar_pop(d, target) AS c_d, covar_pop(m, target) AS c_m, covar_pop(w, target) AS c_w
  FROM features WHERE {TRAIN}),
beta AS (SELECT *, {', '.join(f'{e} AS b_{x}' for x, e in zip('dmw', _cramer()))} FROM mom)
SELECT 'd' AS term, round(b_d, 6) + 0.0 AS beta, n FROM beta UNION ALL SELECT 'w', round(b_w, 6) + 0.0, n FROM beta
UNION ALL SELECT 'm', round(b_m, 6) + 0.0, n FROM beta
UNION ALL SELECT 'intercept', round(y0 - b_d * d0 - b_w * w0 - b_m * m0, 6) + 0.0, n FROM beta""")
def ols_coefficients(spark, sf):
    train, _ = split(t.supplier_features(spark, sf).table)
    coef = regress.fit_ols(train, X3)
    return regress.coefficients_long(coef.table, X3, ["n"]).select("term", rounded("beta", 6).alias("beta"), "n")


@query("M2", f"""WITH {q.nation_dense()}, {q.features('nested', exog=True)},
{q.ols('features', X6, 'target', IDS, TRAIN, 'fit')}
SELECT {DATE}, ticker, round(target, 9) + 0.0 AS target, round(yhat, 6) + 0.0 AS yhat FROM fit WHERE NOT tr""")
def linear_scoring(spark, sf):
    pred = fixed_split_forecast(t.nation_features(spark, sf, exog="exog").table, X6)
    return pred.select(t.text_date(), "ticker", rounded("target").alias("target"), rounded("yhat", 6).alias("yhat"))


@query("M1a", f"""WITH {q.nation_dense()}, {q.features('nested')},
{q.ols('features', X3, 'target', IDS, TRAIN, 'fit', centre_by=['ticker'])}
SELECT {DATE}, ticker, round(yhat, 6) + 0.0 AS yhat FROM fit WHERE NOT tr""")
def fixed_effects_forecast(spark, sf):
    from volarium.session import attach

    train, test = split(t.nation_features(spark, sf).table)
    slopes, alphas = regress.fit_fixed_effects(train, X3)
    # The slope fit is centred, so its own intercept is 0 and the ticker's alpha carries the level.
    out = attach(regress.predict(test, slopes, X3, name="part"), alphas, ["ticker"])
    return out.select(t.text_date(), "ticker", rounded(F.col("part") + F.col("alpha"), 6).alias("yhat"))


GX6 = [*X6, *[f"g_{c}" for c in X6]]
GX3 = [*X3, *[f"g_{c}" for c in X3]]
TOURNAMENT = {"HAR": X3, "HAR+IV": X6, "GHAR": GX3, "GHAR+IV": GX6}


def nested_forecasts(feats, models, keep=("date", "ticker", "target")):
    """Several models by one fixed split: one Gram over the training rows, one projection over the test rows."""
    train, test = split(feats)
    return regress.predict_nested(test, regress.fit_nested(train, models), models, keep)


def tournament(feats, edges, term="ring"):
    """Out-of-sample forecasts of HAR, HAR+IV, GHAR and GHAR+IV on one panel."""
    full = stage(graph.graph_panel(feats, edges, X6, ["self", term]), "graph-panel").table
    rename = lambda c: f"{term}_{c[2:]}" if c.startswith("g_") else f"self_{c}"
    return nested_forecasts(full, {m: [rename(c) for c in xs] for m, xs in TOURNAMENT.items()})


def _tournament_sql(extra_ctes="", edges="ring"):
    fits = ",\n".join(q.ols("gfeat", xs, "target", IDS, TRAIN, f"fit{k}") for k, xs in enumerate(TOURNAMENT.values()))
    union = " UNION ALL ".join(f"SELECT '{m}' AS model, date, ticker, target, yhat FROM fit{k} WHERE NOT tr"
                               for k, m in enumerate(TOURNAMENT))
    return f"""WITH {q.nation_dense()}, {q.features('disjoint', exog=True)}, {q.ring('features', 2)}{extra_ctes},
{q.graph_features(X6, edges=edges)},
{fits},
pred AS ({union})"""


@query("M4 M10 A9 A10 W11 O1", _tournament_sql() + f""",
scores AS (SELECT model, {q.MSE} AS mse, avg({q.qlike(eps_pred=1e-8)}) AS qlike FROM pred GROUP BY 1)
SELECT model, round(mse, 6) + 0.0 AS mse, round(qlike, 6) + 0.0 AS qlike,
  round(mse / max(CASE WHEN model = 'HAR' THEN mse END) OVER (), 6) + 0.0 AS mse_ratio,
  round((max(CASE WHEN model = 'HAR' THEN mse END) OVER () - mse) / max(CASE WHEN model = 'HAR' THEN mse END) OVER () * 100, 5) + 0.0 AS mse_improvement,
  rank() OVER (ORDER BY mse) AS place FROM scores""")
def linear_tournament(spark, sf):
    feats = t.nation_features(spark, sf, har="disjoint", exog="exog").table
    scores = evaluate.loss_table(tournament(feats, t.ring_graph(feats)), ["model"], eps_pred=1e-8)
    table = evaluate.improvement(evaluate.ratio_to_baseline(stage(scores, "scores").table, "HAR"), "HAR")
    out = evaluate.place(table, "mse", "place").orderBy("mse")
    return out.select("model", *[rounded(c, 6).alias(c) for c in ("mse", "qlike", "mse_ratio")],
                      rounded("mse_improvement", 5).alias("mse_improvement"), F.col("place").cast("long").alias("place"))


def daily_features(spark, sf):
    return stage(backtest.renumber(t.nation_features(spark, sf, "day").table), "daily").table


# Feature dates renumbered from 0, as the engine's `renumber`.
DAILY = f"""{q.nation_dense('day')}, {q.features('nested', out='raw')},
fcal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS fpos, count(*) OVER () AS fn FROM (SELECT DISTINCT date FROM raw)),
features AS (SELECT r.date, fpos AS pos, fn AS n_dates, ticker, target, d, w, m FROM raw r JOIN fcal USING (date))"""
FIRST = 1000
COVER = f"""span AS (
  SELECT f.*, o.origin, pos < o.origin AS is_train FROM features f
  JOIN (SELECT DISTINCT pos AS origin FROM features WHERE pos >= {FIRST} AND (pos - {FIRST}) % 22 = 0) o
    ON f.pos >= o.origin - 1000 AND f.pos < least(o.origin + 22, f.n_dates - 1))"""


@query("M3 J7 W9 M1 M2", f"""WITH {DAILY}, {COVER},
{q.ols('span', X3, 'target', ['date', 'ticker', 'pos', 'origin'], 'is_train', 'fit', by=['origin'])}
SELECT {DATE}, ticker, CAST(origin AS BIGINT) AS origin, round(yhat, 6) + 0.0 AS yhat FROM fit WHERE NOT tr""")
def rolling_har(spark, sf):
    pred = backtest.rolling_forecast(daily_features(spark, sf), X3, FIRST)
    return pred.select(t.text_date(), "ticker", F.col("origin").cast("long").alias("origin"), rounded("yhat", 6).alias("yhat"))


@query("M3 J7 J6 M10", f"""WITH {DAILY}, {q.ring('features', 2)}, {q.graph_features(X3)},
gspan AS (SELECT f.*, o.origin, pos < o.origin AS is_train FROM gfeat f
  JOIN (SELECT DISTINCT pos AS origin FROM gfeat WHERE pos >= {FIRST} AND (pos - {FIRST}) % 22 = 0) o
    ON f.pos >= o.origin - 1000 AND f.pos < least(o.origin + 22, f.n_dates - 1)),
{q.ols('gspan', GX3, 'target', ['date', 'ticker', 'pos', 'origin'], 'is_train', 'fit', by=['origin'])}
SELECT origin, round({q.MSE}, 6) + 0.0 AS mse, count(*) AS n FROM fit WHERE NOT tr GROUP BY 1""")
def rolling_graph_har(spark, sf):
    feats = daily_features(spark, sf)
    full = stage(graph.graph_panel(feats, t.ring_graph(feats), X3, ["self", "ring"]), "graph-panel").table
    pred = backtest.rolling_forecast(full, graph.term_columns(["self", "ring"], X3), FIRST)
    return pred.groupBy(F.col("origin").cast("long").alias("origin")).agg(
        rounded(evaluate.loss_columns()["mse"], 6).alias("mse"), F.count(F.lit(1)).alias("n"))


@query("J7", f"""WITH {DAILY}, o AS (SELECT DISTINCT pos AS origin, n_dates FROM features WHERE pos >= {FIRST} AND (pos - {FIRST}) % 22 = 0),
span AS (SELECT o.origin, CASE WHEN f.pos >= o.origin THEN 'test' WHEN f.pos >= o.origin - 22 THEN 'valid' ELSE 'train' END AS part, f.date, f.target
  FROM features f JOIN o ON f.pos >= o.origin - 1000 AND f.pos < least(o.origin + 22, f.n_dates - 1))
SELECT origin, part, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, round(avg(target), 6) + 0.0 AS mean_target
FROM span GROUP BY 1, 2""")
def origin_windows(spark, sf):
    spans = backtest.assign_origins(daily_features(spark, sf), FIRST)
    return spans.groupBy(F.col("origin").cast("long").alias("origin"), "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first_date"),
        F.max("date").cast("string").alias("last_date"), rounded(F.avg("target"), 6).alias("mean_target"))


@query("J7 W9", f"""WITH {DAILY}, e AS (SELECT max(pos) AS last FROM features),
o AS (SELECT unnest(range({FIRST}, last + 1, 22)) AS origin, last FROM e)
SELECT origin, greatest(origin - 1000, 0) AS s_pos, origin - 22 AS v_pos, origin AS o_pos, least(origin + 22, last) AS f_pos FROM o""")
def origin_schedule(spark, sf):
    s = backtest.schedule(daily_features(spark, sf), FIRST)
    return s.select(*[F.col(c).cast("long").alias(c) for c in ("origin", "s_pos", "v_pos", "o_pos", "f_pos")])


@query("A12 P13", f"""WITH {DAILY}, {COVER}
SELECT origin, ticker, round(min(target) FILTER (is_train), 9) + 0.0 AS train_min FROM span GROUP BY 1, 2 HAVING min(target) FILTER (is_train) IS NOT NULL
  AND count(*) FILTER (pos = origin) > 0""")
def training_minimum(spark, sf):
    feats = daily_features(spark, sf)
    mins = backtest.training_minimum(feats, FIRST).filter(F.col("train_min").isNotNull())
    keep = feats.agg(F.max("n_dates").alias("n")).scalar()
    return mins.filter(F.col("origin") < keep - 1).select(
        F.col("origin").cast("long").alias("origin"), "ticker", rounded("train_min").alias("train_min"))


FLOOR_SQL = f"""WITH {q.SUPPLIER_DENSE}, {q.features('nested')},
mins AS (SELECT ticker, min(target) AS train_min FROM features WHERE {TRAIN} GROUP BY 1),
raw AS (SELECT date, ticker, d - 0.8 * m AS y, train_min FROM features JOIN mins USING (ticker) WHERE NOT ({TRAIN})),
out AS (SELECT date, ticker, 'min_if_nonpositive' AS policy, CASE WHEN y <= 0 THEN train_min ELSE y END AS yhat FROM raw
  UNION ALL SELECT date, ticker, 'clip_to_min', greatest(y, train_min) FROM raw
  UNION ALL SELECT date, ticker, 'min_eps_if_nonpositive', CASE WHEN y <= 0 THEN greatest(train_min, 1e-6) ELSE y END FROM raw
  UNION ALL SELECT date, ticker, 'constant', greatest(y, 0.01) FROM raw
  UNION ALL SELECT date, ticker, 'forward_fill', last_value(CASE WHEN y > 0 THEN y END IGNORE NULLS) OVER (
    PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM raw)"""


def floored(spark, sf):
    """A forecast that turns negative, repaired by every policy."""
    from volarium.session import attach

    train, test = split(t.supplier_features(spark, sf).table)
    mins = stage(train.groupBy("ticker").agg(F.min("target").alias("train_min")), "minimum")
    raw = attach(test, mins, ["ticker"]).select("date", "ticker", "train_min", (F.col("d") - 0.8 * F.col("m")).alias("yhat"))
    parts = [backtest.floor_forecasts(raw, p).select("date", "ticker", F.lit(p).alias("policy"), "yhat") for p in backtest.FLOORS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("P13 A12", f"""{FLOOR_SQL}
SELECT policy, {DATE}, ticker, round(yhat, 9) + 0.0 AS yhat FROM out""")
def forecast_floors(spark, sf):
    return floored(spark, sf).select("policy", t.text_date(), "ticker", rounded("yhat").alias("yhat"))


@query("P15", f"""{FLOOR_SQL} SELECT policy, count(*) FILTER (yhat <= 0) AS n_bad, count(*) AS n FROM out GROUP BY 1""")
def positive_forecast_check(spark, sf):
    return evaluate.count_nonpositive(floored(spark, sf), ["policy"])


@query("S8 S9 O4 U1 A21", f"""WITH {DAILY}, {COVER},
f AS (SELECT date, ticker, pos, origin, d, w, m FROM span WHERE NOT is_train)
SELECT run, origin, count(*) AS n, round(sum(yhat), 9) + 0.0 AS total, CAST(max(date) AS VARCHAR) AS last_date FROM (
  SELECT 'DAY' AS run, origin, date, d AS yhat FROM f UNION ALL SELECT 'MONTH', origin, date, m FROM f) GROUP BY 1, 2""")
def forecast_store(spark, sf):
    rows = backtest.test_rows(daily_features(spark, sf), FIRST)
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.col(c).alias("yhat")) for r, c in (("DAY", "d"), ("WEEK", "w"), ("MONTH", "m"))])
    pred = rows.select("origin", "date", "ticker", F.explode(runs).alias("p")).select("p.run", "origin", "date", "ticker", "p.yhat")
    back = scans.forecasts(spark, sinks.forecast_store(pred, scratch_path(spark, "store")), ["DAY", "MONTH"])
    return back.groupBy("run", F.col("origin").cast("long").alias("origin")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("yhat")).alias("total"), F.max("date").cast("string").alias("last_date"))


@query("M3 M5 J7 J6 P13")
def rolling_sparse_graph_har(spark, sf):
    """Every origin re-estimates its graph, its graph features and its regression, in one job each."""
    from volarium.session import attach

    feats = stage(backtest.renumber(t.nation_features(spark, sf).table), "weekly").table
    first, step, look = 180, 44, 150
    rets = cg.nation_returns(spark, sf).select("date", "ticker", "ret")
    lined = stage(rets.join(feats.select("date", "pos").distinct(), "date"), "returns").table
    windows = glasso.origin_returns(lined, backtest.schedule(feats, first, step, look))
    est = glasso.estimate_graph(stage(windows, "windows").table, penalty=0.01).table
    links = graph.normalise(est.filter("src <> dst").select(
        F.concat(F.lit("o"), "origin").alias("graph"), "src", "dst", F.lit(1.0).alias("w")))
    links = links.select(F.substring("graph", 2, 9).cast("int").alias("origin"), F.lit("glasso").alias("graph"), "src", "dst", "w")
    own = est.select("origin", F.lit("self").alias("graph"), "src", F.col("src").alias("dst"), F.lit(1.0).alias("w")).distinct()
    pred = backtest.rolling_graph_forecast(feats, stage(own.unionByName(links), "edges"), X3, ["self", "glasso"], first, step, look)
    mins = stage(backtest.training_minimum(feats, first, step, look), "minimum")
    repaired = backtest.floor_forecasts(attach(pred, mins, ["origin", "ticker"], "left"), "min_if_nonpositive")
    return repaired.select(t.text_date(), "ticker", "origin", "target", "yhat")
