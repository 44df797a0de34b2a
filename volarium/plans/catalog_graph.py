"""Queries: graphs, their normalisation, and join-aggregates over the feature panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from volarium.functions.scalars import rounded
from volarium.operators import backtest, evaluate, glasso, graph, panel, windows
from volarium.plans import sqlkit as q
from volarium.plans import tables as t
from volarium.plans.registry import query
from volarium.session import Staged, attach, stage
from volarium.sources.universes import SIX_NODE_PAIRS

NODES = "nodes AS (SELECT DISTINCT n_name AS ticker FROM nation)"
FEATS = f"{q.nation_dense()}, {q.features('nested')}"
GCOLS = ("d", "w", "m")


def nodes(spark, sf):
    return graph.number_nodes(t.read(spark, sf, "nation").select(F.col("n_name").alias("ticker")))


def nation_returns(spark, sf, unit="week"):
    """Complete log returns of the nation panel with date positions."""
    dense = t.dense_nations(spark, sf, unit)
    filled = panel.backward_fill(dense, "value")
    return panel.log_returns(filled).filter("pos > 0").select("pos", "date", "ticker", "n_dates", "ret")


RETS = f"""{q.nation_dense()},
filled AS (SELECT ticker, date, pos, n_dates, coalesce(value, first_value(value IGNORE NULLS) OVER (
  PARTITION BY ticker ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM dense),
rets AS (SELECT * FROM (SELECT ticker, date, pos, ln(value) - ln(lag(value) OVER (PARTITION BY ticker ORDER BY pos)) AS ret FROM filled) WHERE pos > 0)"""


@query("M6 J6", f"""WITH {q.SUPPLIER_DENSE}, {q.features('nested')}
SELECT CAST(date AS VARCHAR) AS date, ticker, {', '.join(q.rnd(c, f'self_{c}') for c in GCOLS)}, 0.0::DOUBLE AS zero_d FROM features""")
def identity_and_zero_graph(spark, sf):
    feats = t.supplier_features(spark, sf).table
    names = feats.select("ticker").distinct()
    edges = stage(graph.identity_edges(names).unionByName(graph.zero_edges(names)), "edges")
    out = graph.graph_panel(feats, edges, GCOLS, ["self", "zero"])
    return out.select(t.text_date(), "ticker", *[rounded(f"self_{c}").alias(f"self_{c}") for c in GCOLS], "zero_d")


@query("M7 M9", f"""WITH {NODES}, {q.ring('nodes', 3)}
SELECT src, dst, {q.rnd('w', 'w', 6)} FROM ring""")
def ring_graph_weights(spark, sf):
    ring = graph.normalise(graph.edges_from_list(graph.ring_pairs(nodes(spark, sf), 3), "ring"))
    return ring.select("src", "dst", rounded("w", 6).alias("w"))


TRADE = """pairs AS (
  SELECT x, y FROM (
    SELECT least(a.n_name, b.n_name) AS x, greatest(a.n_name, b.n_name) AS y, count(*) AS n, avg(count(*)) OVER () AS mean
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey WHERE a.n_name <> b.n_name GROUP BY 1, 2)
  WHERE n > mean),
links AS (SELECT x AS src, y AS dst FROM pairs UNION ALL SELECT y, x FROM pairs),
deg AS (SELECT src, count(*) AS degree FROM links GROUP BY 1)"""


def trade_edges(spark, sf, share: float = 1.0):
    """Pairs of nations with more shipments between them than `share` times the mean over all pairs that trade."""
    n = t.read(spark, sf, "nation")
    by_ends = (t.read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
               .join(t.read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
               .join(t.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
               .join(t.read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
               .groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n")))
    named = (by_ends.join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("a")), "s_nationkey")
             .join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("b")), "c_nationkey").where("a <> b"))
    pairs = stage(named.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("n").alias("n")), "trade-pairs").table
    mean = pairs.agg(F.avg("n").alias("mean"))
    return graph.edges_from_list(pairs.where(F.col("n") > share * mean.select("mean").scalar()).select("src", "dst"), "trade")


@query("M7 M9 A15", f"""WITH {TRADE}
SELECT l.src, l.dst, round(1 / sqrt((a.degree + 1e-8) * (b.degree + 1e-8)), 6) + 0.0 AS w
FROM links l JOIN deg a ON a.src = l.src JOIN deg b ON b.src = l.dst""")
def trade_graph_weights(spark, sf):
    return graph.normalise(stage(trade_edges(spark, sf), "edges").table).select("src", "dst", rounded("w", 6).alias("w"))


@query("A15", f"""WITH {TRADE}
SELECT src, CAST(degree AS DOUBLE) AS degree, round(sum(degree) OVER () / (SELECT count(*) * (count(*) - 1) FROM nation), 6) + 0.0 AS density FROM deg""")
def degrees_and_density(spark, sf):
    e = stage(trade_edges(spark, sf), "edges").table
    d = graph.density(e, t.read(spark, sf, "nation").count())
    return graph.degrees(e).select("src", "degree", F.round(d.select("density").scalar(), 6).alias("density"))


def _random_sql(kind, seeds):
    cond = "" if kind == "uniform" else "WHERE u < 0.3"
    w = "u" if kind == "uniform" else "1.0"
    return f"""WITH {NODES}, seeds AS (SELECT unnest([{', '.join(map(str, seeds))}]) AS seed),
upper AS (SELECT seed, a.ticker AS src, b.ticker AS dst, {q.uniform('seed', 'a.ticker', 'b.ticker')} AS u
  FROM nodes a, nodes b, seeds WHERE a.ticker < b.ticker),
half AS (SELECT seed, src, dst, {w} AS w FROM upper {cond}),
links AS (SELECT 'random_' || seed AS graph, src, dst, w FROM half UNION ALL SELECT 'random_' || seed, dst, src, w FROM half)"""


@query("M8", _random_sql("uniform", (0, 1, 2)) + " SELECT graph, src, dst, round(w, 6) + 0.0 AS w FROM links")
def random_uniform_graphs(spark, sf):
    return graph.random_edges(nodes(spark, sf), "uniform", (0, 1, 2)).withColumn("w", rounded("w", 6))


@query("M8 M9", _random_sql("bernoulli", (0, 1)) + """, deg AS (SELECT graph, src, sum(w) AS degree FROM links GROUP BY 1, 2)
SELECT l.graph, l.src, l.dst, round(w / sqrt((a.degree + 1e-8) * (b.degree + 1e-8)), 6) + 0.0 AS w
FROM links l JOIN deg a ON a.graph = l.graph AND a.src = l.src JOIN deg b ON b.graph = l.graph AND b.src = l.dst""")
def random_bernoulli_graphs(spark, sf):
    e = stage(graph.random_edges(nodes(spark, sf), "bernoulli", (0, 1), 0.3), "edges").table
    return graph.normalise(e).withColumn("w", rounded("w", 6))


@query("M8 M9", f"""WITH n AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS i, count(*) OVER () AS total FROM supplier),
steps AS (SELECT seed, i, total, k, 1 + floor(ln({q.uniform('seed', 'i', 'k')}) / ln(1 - 0.02)) AS gap
  FROM n, (VALUES (0), (1)) s(seed), (SELECT unnest(range(60 + 3 * (SELECT count(*) FROM supplier) // 50)) AS k) WHERE i < total - 1),
walk AS (SELECT seed, i, total, CAST(i + sum(gap) OVER (PARTITION BY seed, i ORDER BY k) AS BIGINT) AS j FROM steps),
half AS (SELECT 'random_' || seed AS graph, a.ticker AS src, b.ticker AS dst FROM walk w JOIN n a ON a.i = w.i JOIN n b ON b.i = w.j WHERE w.j < w.total),
links AS (SELECT graph, src, dst FROM half UNION ALL SELECT graph, dst, src FROM half),
deg AS (SELECT graph, src, count(*) AS degree FROM links GROUP BY 1, 2)
SELECT l.graph, l.src, l.dst, round(1 / sqrt((a.degree + 1e-8) * (b.degree + 1e-8)), 6) + 0.0 AS w
FROM links l JOIN deg a ON a.graph = l.graph AND a.src = l.src JOIN deg b ON b.graph = l.graph AND b.src = l.dst""")
def random_sparse_graphs(spark, sf):
    """Random graphs over all suppliers in which one pair of fifty is present, by skips."""
    names = graph.number_nodes(t.read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker")))
    return graph.normalise(graph.sparse_random_edges(names, (0, 1), 0.02)).withColumn("w", rounded("w", 6))


@query("J6 M10", f"""WITH {q.SUPPLIER_DENSE}, {q.features('nested')}, {q.ring('features', 2)}, {q.graph_features(GCOLS)}
SELECT CAST(date AS VARCHAR) AS date, ticker, {', '.join(q.rnd(f'g_{c}', f'ring_{c}', 6) for c in GCOLS)} FROM gfeat""")
def neighbour_features(spark, sf):
    feats = t.supplier_features(spark, sf).table
    out = graph.graph_panel(feats, t.ring_graph(feats), GCOLS, ["ring"])
    return out.select(t.text_date(), "ticker", *[rounded(f"ring_{c}", 6).alias(f"ring_{c}") for c in GCOLS])


@query("M10 J6", f"""WITH {q.nation_dense()}, {q.features('disjoint', exog=True)}, {q.ring('features', 2)},
{q.graph_features((*GCOLS, 'iv_d', 'iv_w', 'iv_m'))}
SELECT CAST(date AS VARCHAR) AS date, ticker, {q.rnd('target', 'target')},
  {', '.join(q.rnd(c, f'self_{c}') for c in (*GCOLS, 'iv_d', 'iv_w', 'iv_m'))},
  {', '.join(q.rnd(f'g_{c}', f'ring_{c}', 6) for c in (*GCOLS, 'iv_d', 'iv_w', 'iv_m'))} FROM gfeat""")
def graph_feature_panel(spark, sf):
    feats = t.nation_features(spark, sf, har="disjoint", exog="exog").table
    cols = [*GCOLS, "iv_d", "iv_w", "iv_m"]
    out = graph.graph_panel(feats, t.ring_graph(feats), cols, ["self", "ring"])
    return out.select(t.text_date(), "ticker", rounded("target").alias("target"),
                      *[rounded(c).alias(c) for c in graph.term_columns(["self"], cols)],
                      *[rounded(c, 6).alias(c) for c in graph.term_columns(["ring"], cols)])


@query("A11", f"""WITH {RETS}
SELECT a.ticker AS src, b.ticker AS dst, round(covar_pop(a.ret, b.ret), 6) + 0.0 AS cov
FROM rets a JOIN rets b ON a.pos = b.pos AND a.ticker <= b.ticker GROUP BY 1, 2""")
def return_covariances(spark, sf):
    m = graph.cross_moments(stage(nation_returns(spark, sf), "returns").table, "ret", [])
    return graph.covariances(m).select("src", "dst", rounded("cov", 6).alias("cov"))


@query("A11", f"""WITH {RETS}
SELECT a.ticker AS src, b.ticker AS dst, round(corr(a.ret, b.ret), 6) + 0.0 AS corr
FROM rets a JOIN rets b ON a.pos = b.pos AND a.ticker < b.ticker GROUP BY 1, 2""")
def return_correlations(spark, sf):
    # Small blocks, so that the blocked product runs over several of them.
    m = stage(graph.cross_moments(stage(nation_returns(spark, sf), "returns").table, "ret", [], block=8, chunk=100), "moments")
    return graph.correlations(m.table).select("src", "dst", rounded("corr", 6).alias("corr"))


@query("J4 A15", f"""WITH {NODES}, {TRADE}, grid AS (SELECT a.ticker AS src, b.ticker AS dst FROM nodes a, nodes b)
SELECT g.src, g.dst, CAST(CASE WHEN l.src IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS w
FROM grid g LEFT JOIN links l ON l.src = g.src AND l.dst = g.dst""")
def dense_adjacency(spark, sf):
    grid = graph.node_grid(nodes(spark, sf), "trade")
    return graph.reindex_edges(trade_edges(spark, sf), grid).select("src", "dst", "w")


SIX = sorted({n for pair in SIX_NODE_PAIRS for n in pair})
GIVEN = ", ".join(f"({SIX.index(a)}, {SIX.index(b)})" for a, b in SIX_NODE_PAIRS)


@query("M7 M9 J6", f"""WITH {FEATS}, n AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i FROM (SELECT DISTINCT ticker FROM features)),
given(a, b) AS (VALUES {GIVEN}),
pairs AS (SELECT x.ticker AS src, y.ticker AS dst FROM given JOIN n x ON x.i = a JOIN n y ON y.i = b),
links AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs),
deg AS (SELECT src, count(*) AS degree FROM links GROUP BY 1),
edges AS (SELECT l.src, l.dst, 1 / sqrt((a.degree + 1e-8) * (b.degree + 1e-8)) AS w FROM links l JOIN deg a ON a.src = l.src JOIN deg b ON b.src = l.dst)
SELECT CAST(f.date AS VARCHAR) AS date, e.dst AS ticker, {', '.join(f'round(sum(e.w * f.{c}), 6) + 0.0 AS {c}' for c in GCOLS)} FROM features f JOIN edges e ON e.src = f.ticker GROUP BY 1, 2""")
def given_edge_list(spark, sf):
    """Neighbour features over the given six-node edge list, its nodes being the first six nations."""
    feats = stage(t.nation_features(spark, sf).table, "features").table
    names = graph.number_nodes(feats)
    pairs = spark.createDataFrame([(SIX.index(a), SIX.index(b)) for a, b in SIX_NODE_PAIRS], "a long, b long")
    end = lambda c, n: Staged(names.table.select(F.col("i").cast("long").alias(c), F.col("ticker").alias(n)), names.rows)
    named = attach(attach(pairs, end("a", "src"), ["a"]), end("b", "dst"), ["b"]).select("src", "dst")
    edges = stage(graph.normalise(graph.edges_from_list(named, "given")), "edges")
    return graph.propagate(feats, edges, GCOLS).select(t.text_date(), "ticker", *[rounded(c, 6).alias(c) for c in GCOLS])


def one_origin(returns, share=0.7):
    """Training dates of a single fixed split as origin 0."""
    return returns.filter(F.col("pos") < F.floor(F.col("n_dates") * share)).withColumn("origin", F.lit(0))


@query("M5 M5a")
def sparse_precision_graph(spark, sf):
    rets = stage(one_origin(nation_returns(spark, sf)), "returns").table
    return glasso.estimate_graph(rets).table


@query("M5 M5a P10 P17 J7 J10")
def sparse_precision_by_origin(spark, sf):
    from volarium.operators.backtest import schedule

    rets = stage(nation_returns(spark, sf), "returns").table
    origins = schedule(rets, 200, 44, 150)
    return glasso.estimate_graph(stage(glasso.origin_returns(rets, origins), "windows").table, refinements=2).table


@query("M5a", f"""WITH {RETS}
SELECT 0 AS origin, count(DISTINCT pos) AS n_dates, count(DISTINCT pos) < 2 * pow((SELECT count(DISTINCT ticker) FROM rets), 2) AS short FROM rets
WHERE pos < (SELECT floor(count(*) * 0.7) FROM cal)""")
def short_sample_warning(spark, sf):
    rets = stage(nation_returns(spark, sf), "returns").table
    return glasso.sample_warning(one_origin(rets), graph.number_nodes(rets).rows)


# Returns of a panel in which some tickers are listed only from position 220 on, so that they are missing in the first windows.
LATE = f"""{RETS}, late AS (SELECT * FROM rets WHERE ticker >= 'C' OR pos >= 220),
o AS (SELECT unnest(range(200, (SELECT max(pos) FROM late) + 1, 44)) AS origin),
pairs AS (SELECT o.origin, a.ticker AS src, b.ticker AS dst, count(*) AS n, corr(a.ret, b.ret) AS corr
  FROM o JOIN late a ON a.pos >= greatest(o.origin - 150, 0) AND a.pos < o.origin JOIN late b ON b.pos = a.pos AND a.ticker < b.ticker GROUP BY ALL)"""


def late_pairs(spark, sf):
    rets = nation_returns(spark, sf).filter((F.col("ticker") >= "C") | (F.col("pos") >= 220))
    rets = stage(rets, "returns").table
    return windows.window_correlations(windows.window_moments(rets, "ret", backtest.schedule(rets, 200, 44, 150), block=8))


@query("J7 P17 P10 J10 A11", f"WITH {LATE} SELECT origin, src, dst, n, round(corr, 6) + 0.0 AS corr FROM pairs")
def origin_correlations(spark, sf):
    """Correlations in the look-back window of every origin, over the dates that two tickers share in it."""
    return late_pairs(spark, sf).select(F.col("origin").cast("long").alias("origin"), "src", "dst", "n", rounded("corr", 6).alias("corr"))


@query("M5 M9 J7 P17", f"""WITH {LATE}, near AS (SELECT * FROM pairs WHERE abs(corr) >= 0.1 AND n >= 30),
links AS (SELECT origin, src, dst FROM near UNION ALL SELECT origin, dst, src FROM near),
deg AS (SELECT origin, src, count(*) AS degree FROM links GROUP BY ALL)
SELECT l.origin, l.src, l.dst, round(1 / sqrt((a.degree + 1e-8) * (b.degree + 1e-8)), 6) + 0.0 AS w
FROM links l JOIN deg a ON a.origin = l.origin AND a.src = l.src JOIN deg b ON b.origin = l.origin AND b.src = l.dst""")
def origin_correlation_graph(spark, sf):
    """A graph of its own for every origin: tickers whose returns correlate in its window, normalised."""
    edges = stage(windows.correlation_graph(late_pairs(spark, sf), 0.1, 30), "edges").table
    return graph.normalise(edges.withColumn("graph", F.col("origin").cast("string"))).select(F.col("graph").cast("long").alias("origin"), "src", "dst", rounded("w", 6).alias("w"))


ROLL = (200, 44, 150)  # first origin, step, look-back
ROLL_SQL = f"""WITH {LATE}, near AS (SELECT * FROM pairs WHERE abs(corr) >= 0.1 AND n >= 30),
links AS (SELECT origin, src, dst FROM near UNION ALL SELECT origin, dst, src FROM near),
deg AS (SELECT origin, src, count(*) AS degree FROM links GROUP BY ALL),
edges AS (SELECT l.origin, l.src, l.dst, 1 / sqrt((a.degree + 1e-8) * (b.degree + 1e-8)) AS w
  FROM links l JOIN deg a ON a.origin = l.origin AND a.src = l.src JOIN deg b ON b.origin = l.origin AND b.src = l.dst),
{q.features('nested')},
span AS (SELECT f.*, o.origin, f.pos < o.origin AS is_train FROM features f JOIN o ON f.pos >= o.origin - 150 AND f.pos < least(o.origin + 44, f.n_dates - 1)),
{q.graph_features(GCOLS, 'edges', 'span', on=['origin'])},
{q.ols('gfeat', [*GCOLS, *(f'g_{c}' for c in GCOLS)], 'target', ['date', 'ticker', 'pos', 'origin'], 'is_train', 'fit', by=['origin'])}
SELECT origin, round({q.MSE}, 5) + 0.0 AS mse, count(*) AS n FROM fit WHERE NOT tr GROUP BY 1"""


@query("M3 J6 J7 M10 P17", ROLL_SQL)
def rolling_correlation_graph_har(spark, sf):
    """Every origin is fitted and forecast with the correlation graph of its own look-back window."""
    first, step, look_back = ROLL
    feats = t.nation_features(spark, sf).table
    links = windows.correlation_graph(late_pairs(spark, sf), 0.1, 30)
    weighted = graph.normalise(stage(links.withColumn("graph", F.col("origin").cast("string")), "links").table)
    origins = links.agg(F.array_sort(F.collect_set("origin")).alias("o")).scalar()
    own = graph.identity_edges(feats.select("ticker").distinct()).withColumn("origin", F.explode(origins))
    edges = weighted.select(F.col("graph").cast("int").alias("origin"), F.lit("g").alias("graph"), "src", "dst", "w").unionByName(own.select("origin", "graph", "src", "dst", "w"))
    pred = backtest.rolling_graph_forecast(feats, stage(edges, "origin-edges"), list(GCOLS), ["self", "g"], first, step, look_back)
    mse = evaluate.loss_columns()["mse"]
    return pred.groupBy(F.col("origin").cast("long").alias("origin")).agg(rounded(mse, 5).alias("mse"), F.count(F.lit(1)).alias("n"))
