"""Graph-network forecasters: scoring as join-aggregates, and a fan-out of small independent fits.

Weights are rows (run, layer, i, j, value). Layer 0 is the direct linear term (i = -1: its bias), layers
1..depth are the graph layers (i = -1: bias), layer depth + 1 maps the last hidden state to the forecast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volarium.functions.scalars import HEADS
from volarium.operators.graph import SELF, graph_panel
from volarium.session import Staged, attach, spread, stage

# Hidden width, dates per batch, step size, weight decay, epochs.
HIDDEN, BATCH, RATE, DECAY, EPOCHS = 9, 128, 1e-3, 1e-5, 5000
# Graph layers per model, and whether a layer's sum passes through a rectifier.
MODELS = {"HAR": (0, True), "GHAR": (1, False), "GNN1L": (1, True), "GNN2L": (2, True), "GNN3L": (3, True)}


def pack_weights(weights: DataFrame, keys: Sequence[str] = ("run",)) -> Staged:
    """One row per key with a map layer -> values ordered by (i, j); at most a few hundred per key."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "value"))), lambda s: s["value"])
    layers = weights.groupBy(*keys, "layer").agg(ordered.alias("v"))
    return stage(layers.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("layer", "v"))).alias("layers")),
                 "weights")


def _project(inputs: list[str], width: int, j: int, first: int = 1):
    """Column j of x times a packed matrix in `v` whose row `first` belongs to the first input."""
    terms = [F.col(c) * F.col("v").getItem((i + first) * width + j) for i, c in enumerate(inputs)]
    return reduce(lambda a, b: a + b, terms)


def score(features: DataFrame, edges: Staged, weights: Staged, columns: Sequence[str], model: str,
          graph: str, hidden: int = HIDDEN, head: str = "relu", on: Sequence[str] = ("run",)) -> DataFrame:
    """Forecasts of given weights: adds `yhat` to (on..., date, ticker, pos, n_dates, target).

    `weights` is packed by `on`; the features either carry those keys or are repeated for every run.
    Each graph layer is one join with the edges and one aggregation by date. The features are laid out
    by date once and stay so through all layers. `edges` holds the identity graph next to `graph`.
    """
    depth, rectify = MODELS[model]
    width = hidden if rectify else 1
    columns, on = list(columns), list(on)
    base = ["pos", "n_dates", "target"]

    def with_layer(df: DataFrame, layer: int) -> DataFrame:
        packed = Staged(weights.table.select(*on, F.col("layers").getItem(layer).alias("v")), weights.rows)
        return attach(df, packed, on)

    missing = [k for k in on if k not in features.columns]
    if missing:
        runs = weights.table.select(*missing).distinct()
        keys = runs.agg(F.collect_list(F.struct(*missing)).alias("k")).scalar()
        features = features.withColumn("k", F.explode(keys)).select("*", "k.*").drop("k")
    rows = with_layer(features.repartition("date"), 0)
    rows = rows.withColumn("own", F.col("v").getItem(0) + _project(columns, 1, 0)).drop("v")
    state = columns
    for layer in range(1, depth + 1):
        rows = with_layer(rows, layer)
        z = [f"z{j}" for j in range(width)]
        bias = [f"b{j}" for j in range(width)]
        rows = rows.withColumns({**{n: _project(state, width, j) for j, n in enumerate(z)},
                                 **{n: F.col("v").getItem(j) for j, n in enumerate(bias)}})
        shared = [k for k in on if k in edges.table.columns]
        keys = [k for k in on if k not in shared]
        # Keys that only the features have are carried as grouping columns of the same aggregation.
        out = graph_panel(rows, edges, z, [graph], carry=[*base, "own", *bias], on=shared, runs=keys, by_date=True)
        state = [f"h{j}" for j in range(width)]
        act = HEADS["relu" if rectify else "none"]
        rows = out.select(*on, "date", "ticker", *base, "own",
                          *[act(F.col(f"{graph}_{n}") + F.col(b)).alias(h) for n, b, h in zip(z, bias, state)])
    if depth:
        rows = with_layer(rows, depth + 1)
        rows = rows.withColumn("own", F.col("own") + _project(state, 1, 0, first=0))
    return rows.select(*on, "date", "ticker", *base, HEADS[head]("own").alias("yhat"))


def tensors(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per date: tickers in sorted order with their inputs and targets, 0 for a missing input.

    A row holds one date's cross-section, so it is bounded by the number of tickers.
    """
    cell = F.struct("ticker", F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns]).alias("x"),
                    F.coalesce("target", F.lit(0.0)).alias("y"))
    cells = features.groupBy(*keys, "date", "pos").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    return cells.select(*keys, "date", "pos", F.col("c.ticker").alias("tickers"), F.col("c.x").alias("x"), F.col("c.y").alias("y"))


def label_forecasts(arrays: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Arrays (tickers, yhat) per date back to labelled rows."""
    return arrays.select(*keys, F.explode(F.arrays_zip("tickers", "yhat")).alias("e")) \
        .select(*keys, F.col("e.tickers").alias("ticker"), F.col("e.yhat").alias("yhat"))


BUCKET = 1024  # tickers of one array


def bucket_tensors(features: DataFrame, nodes: Staged, columns: Sequence[str], keys: Sequence[str] = (), size: int = BUCKET) -> DataFrame:
    """Dense arrays of numbered tickers (ticker, i), `size` of them a row: (keys, date, pos, bucket, x, y, present).

    Place k of a bucket's arrays is ticker number bucket * size + k on every date, so no row carries names and none is longer than
    `size`, however many tickers there are. A ticker without a row on a date has inputs and target 0 and is not `present`.

    Cells and one marker a bucket and date are shuffled once, by bucket and date; behind that exchange a marker expands to its
    places, and both groupings reuse the partitioning.
    """
    keys, n = list(keys), len(columns)
    place = Staged(nodes.table.select("ticker", F.floor(F.col("i") / size).cast("int").alias("bucket"), F.pmod("i", F.lit(size)).cast("int").alias("at")), nodes.rows)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x")
    cells = attach(features.select(*keys, "date", "pos", "ticker", x, F.coalesce("target", F.lit(0.0)).alias("y")), place, ["ticker"]).drop("ticker")
    last = (nodes.rows - 1) // size
    markers = features.select(*keys, "date", "pos").distinct().select(*keys, "date", "pos", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bucket"))
    both = cells.unionByName(markers, allowMissingColumns=True).repartition(*keys, "date", "pos", "bucket")
    places = F.sequence(F.lit(0), F.least(F.lit(size), F.lit(nodes.rows) - F.col("bucket") * size).cast("int") - 1)
    slots = both.select(*keys, "date", "pos", "bucket", "x", "y", F.explode(F.when(F.col("at").isNull(), places).otherwise(F.array("at"))).alias("at"))
    filled = slots.groupBy(*keys, "date", "pos", "bucket", "at").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    cell = F.struct("at", F.coalesce("x", F.array(*[F.lit(0.0)] * n)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.col("x").isNotNull().alias("present"))
    rows = filled.groupBy(*keys, "date", "pos", "bucket").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    return rows.select(*keys, "date", "pos", "bucket", F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.present").alias("present"))


def label_buckets(arrays: DataFrame, nodes: Staged, keys: Sequence[str] = ("date",), size: int = BUCKET) -> DataFrame:
    """Forecast arrays (bucket, yhat, present) back to rows (keys, ticker, yhat) of the tickers that were present."""
    cells = arrays.select(*keys, "bucket", F.posexplode(F.arrays_zip("yhat", "present")).alias("at", "cell")).where("cell.present")
    numbered = cells.select(*keys, (F.col("bucket") * size + F.col("at")).cast("long").alias("i"), F.col("cell.yhat").alias("yhat"))
    return attach(numbered, Staged(nodes.table.select(F.col("i").cast("long").alias("i"), "ticker"), nodes.rows), ["i"]).select(*keys, "ticker", "yhat")


def _loss(kind: str, y: np.ndarray, f: np.ndarray) -> tuple[float, np.ndarray]:
    """Training loss and its derivative by the forecast."""
    if kind == "mse":
        return float(np.mean((f - y) ** 2)), 2 * (f - y) / y.size
    if kind == "qlike":  # ratio over forecast + 1e-4, no constant
        g = f + 1e-4
        live = np.ones_like(g)
    else:  # "qlike_floor": forecast not below 1e-6
        g = np.maximum(f, 1e-6)
        live = (f > 1e-6).astype(float)
    r = np.maximum(y, 1e-12) / g
    return float(np.mean(r - np.log(r))), live * (1 / g - r / g) / y.size


def _forward(p: dict, x: np.ndarray, adj: np.ndarray, depth: int, rectify: bool, head: str):
    h, trace = x, []
    for layer in range(1, depth + 1):
        mixed = adj @ h
        z = mixed @ p[layer][1:] + p[layer][0]
        trace.append((mixed, z))
        h = np.maximum(z, 0) if rectify else z
    raw = (x @ p[0][1:] + p[0][0])[..., 0]
    if depth:
        raw = raw + (h @ p[depth + 1])[..., 0]
    if head == "relu":
        return np.maximum(raw, 0), (raw > 0).astype(float), h, trace
    return np.logaddexp(0, raw) + (1e-6 if head == "softplus_shift" else 0), 1 / (1 + np.exp(-raw)), h, trace


def _gradients(p: dict, x, adj, depth, rectify, d_raw, h, trace) -> dict:
    d = d_raw[..., None]
    flat = lambda a: a.reshape(-1, a.shape[-1])
    g = {0: np.vstack([d.sum().reshape(1, 1), flat(x).T @ flat(d)])}
    if depth:
        g[depth + 1] = flat(h).T @ flat(d)
        dh = d @ p[depth + 1].T
        for layer in range(depth, 0, -1):
            mixed, z = trace[layer - 1]
            dz = dh * (z > 0) if rectify else dh
            g[layer] = np.vstack([flat(dz).sum(0), flat(mixed).T @ flat(dz)])
            dh = adj.T @ (dz @ p[layer][1:].T)
    return g


def _start(rng: np.random.Generator, n_in: int, width: int, depth: int, own: bool = True) -> dict:
    edge = 1 / np.sqrt(n_in)
    p = {0: rng.uniform(-edge, edge, (n_in + 1, 1))}
    p[0][1:] *= own
    size = n_in
    for layer in range(1, depth + 1):
        bound = np.sqrt(2.0) * np.sqrt(6 / (size + width))
        p[layer] = np.vstack([np.zeros((1, width)), rng.uniform(-bound, bound, (size, width))])
        size = width
    if depth:
        p[depth + 1] = rng.uniform(-1 / np.sqrt(width), 1 / np.sqrt(width), (width, 1))
    return p


def fit_window(x, y, adj, n_train: int, cfg: dict, seed: int) -> tuple[dict, np.ndarray]:
    """One fit: Adam on batches of dates, weights of the epoch with the lowest mean validation loss.

    Layer biases (row 0 of a graph layer) stay 0 unless `layer_bias`; without `own` the direct linear
    term is only a bias. Returns (weights, losses per epoch).
    """
    depth, rectify = MODELS[cfg["model"]]
    width = cfg["hidden"] if rectify else 1
    rng = np.random.default_rng(seed)
    p = _start(rng, x.shape[-1], width, depth, cfg["own"])
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    best, best_loss, history, step = p, np.inf, [], 0
    run = lambda q, a: _forward(q, a, adj, depth, rectify, cfg["head"])
    for _ in range(cfg["epochs"]):
        order, losses = rng.permutation(n_train), []
        for at in range(0, n_train, cfg["batch"]):
            b = order[at:at + cfg["batch"]]
            f, slope, h, trace = run(p, x[b])
            value, d_f = _loss(cfg["loss"], y[b], f)
            losses.append(value)
            g = _gradients(p, x[b], adj, depth, rectify, d_f * slope, h, trace)
            if cfg.get("clip"):
                norm = np.sqrt(sum(float(np.sum(v ** 2)) for v in g.values()))
                g = {k: v * min(1.0, cfg["clip"] / max(norm, 1e-12)) for k, v in g.items()}
            step += 1
            for k in p:
                d = g[k] + cfg["decay"] * p[k]
                if 1 <= k <= depth and not cfg["layer_bias"]:
                    d[0] = 0.0
                if k == 0 and not cfg["own"]:
                    d[1:] = 0.0
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d ** 2
                p = {**p, k: p[k] - cfg["rate"] * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)}
        valid = _loss(cfg["loss"], y[n_train:], run(p, x[n_train:])[0])[0]
        history.append((float(np.mean(losses)), valid))
        if not np.isfinite(valid):
            break
        if valid < best_loss:
            best, best_loss = p, valid
    return best, np.array(history)


def needs_restart(valid: np.ndarray) -> bool:
    """More than half of the validation steps flat, or a final loss beyond 100 (or not a number)."""
    flat = np.sum(np.abs(np.diff(valid)) < 1e-6) / len(valid)
    return bool(flat > 0.5 or not valid[-1] <= 100)


OUT = "run string, origin int, seed int, kind string, layer int, i int, j int, value double"


def fit_tournament(features: DataFrame, edges: DataFrame, columns: Sequence[str], runs: Sequence[dict],
                   seeds: Sequence[int], retries: int = 3) -> Staged:
    """All (run, origin, seed) fits in one job.

    features: (origin, part in train/valid, date, pos, ticker, inputs, target) from the origin schedule;
    edges: (origin, graph, src, dst, w); runs: dicts with name, model, graph, loss and optionally head,
    hidden, epochs, batch, rate, decay, clip, own, layer_bias. A fit sees one origin's window (at most 1000 dates), never
    more, so work grows by adding fits. Output rows: weights (kind w), losses per epoch (train, valid),
    number of restarts (restarts).
    """
    spark = features.sparkSession
    configs = {r["name"]: {"head": "relu", "hidden": HIDDEN, "epochs": EPOCHS, "batch": BATCH, "rate": RATE,
                           "decay": DECAY, "own": True, "layer_bias": False, **r} for r in runs}
    jobs = spark.createDataFrame([(n, c["graph"], int(s)) for n, c in configs.items() for s in seeds],
                                 "run string, graph string, seed int")
    jobs = Staged(jobs, len(configs) * len(seeds))
    # Every date row meets every run: the number of runs is a configuration, a few dozen at most.
    all_jobs = jobs.table.agg(F.collect_list(F.struct("run", "graph", "seed")).alias("k")).scalar()
    dates = tensors(features, columns, ["origin", "part"])
    rows = dates.withColumn("k", F.explode(all_jobs)).select("k.run", "k.seed", "origin", "part", "pos", "tickers", "x", "y")
    links = edges.select("origin", "graph", "src", "dst", "w").withColumn("k", F.explode(all_jobs)) \
        .filter(F.col("k.graph") == F.col("graph")).select("k.run", "k.seed", "origin", "src", "dst", "w")

    def fit(key: tuple, data: pd.DataFrame, link: pd.DataFrame) -> pd.DataFrame:
        if data.empty:
            return pd.DataFrame(columns=["run", "origin", "seed", "kind", "layer", "i", "j", "value"])
        run, seed, origin = key
        cfg = configs[run]
        data = data.sort_values("pos")
        names = sorted({t for ts in data.tickers for t in ts})
        place = {t: k for k, t in enumerate(names)}
        x = np.zeros((len(data), len(names), len(columns)))
        y = np.zeros((len(data), len(names)))
        for d, (ts, xs, ys) in enumerate(zip(data.tickers, data.x, data.y)):
            at = [place[t] for t in ts]
            x[d, at], y[d, at] = np.stack(xs), ys
        adj = np.zeros((len(names), len(names)))
        for a, b, w in zip(link.src, link.dst, link.w):
            if a in place and b in place:
                adj[place[b], place[a]] = w
        n_train, tries = int((data.part == "train").sum()), 0
        weights, history = fit_window(x, y, adj, n_train, cfg, seed)
        while needs_restart(history[:, 1]) and tries < retries:
            tries += 1
            weights, history = fit_window(x, y, adj, n_train, cfg, seed + 10_000 * tries)
        out = [(run, origin, seed, "restarts", 0, 0, 0, float(tries))]
        for e, (a, b) in enumerate(history):
            out += [(run, origin, seed, "train", 0, e, 0, a), (run, origin, seed, "valid", 0, e, 0, b)]
        depth = MODELS[cfg["model"]][0]
        for layer, w in weights.items():
            first = 0 if depth and layer == depth + 1 else -1
            out += [(run, origin, seed, "w", layer, i + first, j, float(w[i, j]))
                    for i in range(w.shape[0]) for j in range(w.shape[1])]
        return pd.DataFrame(out, columns=["run", "origin", "seed", "kind", "layer", "i", "j", "value"])

    keys = ["run", "seed", "origin"]
    rows, links = spread(rows, *keys), spread(links, *keys)
    return stage(rows.groupBy(*keys).cogroup(links.groupBy(*keys)).applyInPandas(fit, OUT), "gnn-fits")


def fit_weights(fits: DataFrame) -> DataFrame:
    return fits.filter("kind = 'w'").select("run", "origin", "seed", "layer", "i", "j", "value")


def fit_history(fits: DataFrame) -> DataFrame:
    """(run, origin, seed, epoch, train, valid)."""
    return fits.filter("kind IN ('train', 'valid')").groupBy("run", "origin", "seed", F.col("i").alias("epoch")).agg(
        F.max(F.when(F.col("kind") == "train", F.col("value"))).alias("train"),
        F.max(F.when(F.col("kind") == "valid", F.col("value"))).alias("valid"))
