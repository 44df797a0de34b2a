"""Graphs as edge lists (graph, src, dst, w) and their join-aggregates over feature panels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volarium.functions.scalars import keyed_uniform
from volarium.operators.ordering import number_rows
from volarium.session import BROADCAST_ROWS, Staged, attach, spread, stage

SELF = "self"
DRAWS = 2_000_000         # draws of a sparse random graph that one task walks, on average
DEGREE_ROWS = 1_000_000   # degrees that are broadcast to the edges


def identity_edges(nodes: DataFrame, graph: str = SELF) -> DataFrame:
    """One self-loop of weight 1 per node: turns a node's own features into a graph term."""
    return nodes.select(F.lit(graph).alias("graph"), F.col("ticker").alias("src"),
                        F.col("ticker").alias("dst"), F.lit(1.0).alias("w"))


def zero_edges(nodes: DataFrame, graph: str = "zero") -> DataFrame:
    """The graph without edges; its terms come out as 0."""
    return identity_edges(nodes, graph).limit(0)


def edges_from_list(pairs: DataFrame, graph: str, symmetric: bool = True) -> DataFrame:
    """Edge list from given pairs (src, dst[, w]); mirrored when symmetric, repeated pairs merged."""
    if "w" not in pairs.columns:
        pairs = pairs.withColumn("w", F.lit(1.0))
    both = pairs.select("src", "dst", "w")
    if symmetric:
        both = both.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    merged = both.filter("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w"))
    return merged.select(F.lit(graph).alias("graph"), "src", "dst", "w")


def number_nodes(nodes: DataFrame) -> Staged:
    """(ticker, i): distinct nodes with their 0-based place in ticker order."""
    return number_rows(nodes.select("ticker").distinct(), "ticker", "i")


def ring_pairs(nodes: Staged, reach: int = 2) -> DataFrame:
    """Each numbered node with the next `reach` nodes in ticker order, closing the circle: `reach` rows per node."""
    out = nodes.table.select(F.col("ticker").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("step"), "i")
    out = out.withColumn("i", F.pmod(F.col("i") + F.col("step"), F.lit(nodes.rows)))
    return attach(out, Staged(nodes.table.select(F.col("ticker").alias("dst"), "i"), nodes.rows), ["i"]).select("src", "dst")


def random_edges(nodes: Staged, kind: str, seeds: Sequence[int], density: float | Sequence[float] | None = None) -> DataFrame:
    """Seeded symmetric random graphs over numbered nodes, one per seed, before normalisation.

    ``uniform`` gives every pair a uniform weight; ``bernoulli`` keeps a pair with probability
    `density` (one value, or one per seed). The draw of a pair depends only on (seed, src, dst). Pairs
    come from a generator over node numbers, since a dense graph has one row per pair by definition.
    """
    last = F.lit(nodes.rows - 1)
    p = list(density) if isinstance(density, Sequence) else [density or 0.0] * len(seeds)
    runs = F.array(*[F.struct(F.lit(int(s)).alias("seed"), F.lit(float(d)).alias("p")) for s, d in zip(seeds, p)])
    half = spread(nodes.table, "i").filter(F.col("i") < last).select(
        F.col("ticker").alias("src"), F.explode(F.sequence(F.col("i") + 1, last)).alias("i"))
    named = attach(half, Staged(nodes.table.select(F.col("ticker").alias("dst"), "i"), nodes.rows), ["i"])
    drawn = named.select("src", "dst", F.explode(runs).alias("r")).select("src", "dst", "r.seed", "r.p") \
        .withColumn("u", keyed_uniform("seed", "src", "dst"))
    if kind == "uniform":
        kept = drawn.withColumn("w", F.col("u"))
    elif kind == "bernoulli":
        kept = drawn.filter(F.col("u") < F.col("p")).withColumn("w", F.lit(1.0))
    else:
        raise ValueError(f"kind must be 'uniform' or 'bernoulli', found {kind!r}")
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return kept.select(F.concat(F.lit("random_"), F.col("seed").cast("string")).alias("graph"), "w", ends.alias("e")) \
        .select("graph", "e.src", "e.dst", "w")


def sparse_random_edges(nodes: Staged, seeds: Sequence[int], density: float) -> DataFrame:
    """Seeded symmetric random graphs in which every pair is present with probability `density`: (graph, src, dst, w), both ways.

    The pairs that are absent are skipped, not drawn: from one partner of a node to the next the number of places is geometric,
    1 + floor(ln u / ln(1 - density)), so work follows the edges and not the pairs. Draw k of a node depends on (seed, node number, k)
    only. Draws come in rounds of a little more than the expected number; a node whose last draw is still short of
    the end goes on from there in the next round, which few nodes reach. Of an edge one row of numbers is written; names and the
    other direction come with every read.
    """
    if not 0 < density < 1:
        raise ValueError(f"a density must lie between 0 and 1, found {density}")
    last = nodes.rows - 1
    runs = F.array(*[F.lit(int(s)).alias("seed") for s in seeds])
    line = density * nodes.rows / 2  # partners of a node on average
    tasks = max(int(nodes.table.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(len(seeds) * nodes.rows * (line + 3 * math.sqrt(line) + 3) / DRAWS))
    place = "int" if nodes.rows < 1 << 31 else "long"
    state = nodes.table.repartition(tasks, "i").where(F.col("i") < last).select(F.explode(runs).alias("seed"), F.col("i").cast("long").alias("i"), F.col("i").cast("long").alias("from"), F.lit(0).cast("long").alias("k"))
    state, found = Staged(state, nodes.rows), None
    while True:
        mean = (F.lit(last) - F.col("from")) * density
        most = F.ceil(mean + 3 * F.sqrt(mean) + 2)
        draws = state.table.select("seed", "i", "from", F.explode(F.sequence(F.col("k"), F.col("k") + most - 1)).alias("k"), (F.col("k") + most).alias("next"))
        gap = 1 + F.floor(F.log(keyed_uniform("seed", "i", "k")) / F.lit(float(np.log1p(-density))))
        walk = Window.partitionBy("seed", "i").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        # Short of the end are the nodes whose last draw of the round is still on the line.
        short = F.when((F.col("k") == F.col("next") - 1) & (F.col("j") < last), F.col("next"))
        placed = stage(draws.withColumn("j", F.col("from") + F.sum(gap).over(walk)).where(F.col("j") <= last)
                       .select("seed", "i", F.col("j").cast(place).alias("j"), short.alias("next")), "random-edges")
        part = placed.table.select("seed", "i", F.col("j").cast("long").alias("j"))
        found = part if found is None else found.unionByName(part)
        state = stage(placed.table.where("next IS NOT NULL").select("seed", "i", F.col("j").cast("long").alias("from"), F.col("next").alias("k")), "random-open")
        if not state.rows:
            break
    name = lambda c, n: Staged(nodes.table.select(F.col("i").cast("long").alias(c), F.col("ticker").alias(n)), nodes.rows)
    named = attach(attach(found, name("i", "src"), ["i"]), name("j", "dst"), ["j"])
    half = named.select(F.concat(F.lit("random_"), F.col("seed").cast("string")).alias("graph"), "src", "dst", F.lit(1.0).alias("w"))
    # One direction after the other, so that a node's name stands in a run, which packs well.
    return half.unionByName(half.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph", "src").agg(F.sum("w").alias("degree"))


def density(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Share of possible directed off-diagonal edges that are present."""
    return edges.filter("src <> dst").groupBy("graph").agg(
        F.count(F.lit(1)).alias("n_edges"),
        (F.count(F.lit(1)) / F.lit(n_nodes * (n_nodes - 1))).alias("density"))


def normalise(edges: DataFrame, eps: float = 1e-8, zero_degree: float | None = None) -> DataFrame:
    """w_ij / sqrt(d_i d_j) without self-loops.

    Either `eps` is added to every degree, or a degree of 0 is replaced by `zero_degree`. The graph is
    symmetric, so a node's degree is the same over either end. The degrees are written and counted; up to `DEGREE_ROWS` of them go to
    the edges, which then are not shuffled.
    """
    off = edges.filter("src <> dst")
    safe = F.when(F.col("degree") == 0, F.lit(zero_degree)).otherwise(F.col("degree")) if zero_degree \
        else F.col("degree") + F.lit(eps)
    deg = stage(degrees(off).withColumn("degree", safe), "degrees")
    at = lambda end: Staged(deg.table.select("graph", F.col("src").alias(end), F.col("degree").alias(f"d_{end}")), deg.rows)
    ends = attach(attach(off, at("src"), ["graph", "src"], max_rows=DEGREE_ROWS), at("dst"), ["graph", "dst"], max_rows=DEGREE_ROWS)
    return ends.select("graph", "src", "dst", (F.col("w") / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("w"))


def node_grid(nodes: Staged, graph: str) -> DataFrame:
    """(graph, src, dst) for every ordered pair of numbered nodes: one row a pair by definition, generated by number, named by joins."""
    last = F.lit(nodes.rows - 1).cast("long")
    pairs = spread(nodes.table, "i").select(F.col("ticker").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    named = attach(pairs, Staged(nodes.table.select(F.col("ticker").alias("dst"), F.col("i").cast("long").alias("i")), nodes.rows), ["i"])
    return named.select(F.lit(graph).alias("graph"), "src", "dst")


def reindex_edges(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """Weights on a given list of (graph, src, dst); absent pairs get 0."""
    return grid.join(edges, ["graph", "src", "dst"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def _meet(features: DataFrame, edges: Staged, on: Sequence[str], salt: int, by_date: bool = False) -> DataFrame:
    """Features joined to the edges that leave each node, laid out for an aggregation by date.

    With an edge list under the broadcast limit the features are partitioned by date and the T x E
    products are aggregated where they arise, never shuffled. A longer edge list is joined on
    (src, salt): the salt, a hash of the date, spreads a hub's rows over `salt` tasks. `by_date` says that
    the features already lie by date, as the output of an earlier graph step does.
    """
    e = edges.table.filter("w <> 0").withColumnsRenamed({"src": "ticker", "w": "edge_weight"})
    if edges.rows <= BROADCAST_ROWS:
        laid_out = features if by_date else features.repartition("date", *on)
        return laid_out.join(F.broadcast(e), [*on, "ticker"])
    salted = e.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return features.withColumn("salt", F.pmod(F.hash("date"), F.lit(salt))).join(salted, [*on, "ticker", "salt"])


def propagate(features: DataFrame, edges: Staged, columns: Sequence[str], on: Sequence[str] = (),
              salt: int = 16) -> DataFrame:
    """Sum of w * x over a node's neighbours: (on..., date, graph, ticker, columns...).

    `on` lists further keys that edges and features share (an origin, a run). A node without a
    neighbour on a date gives no row.
    """
    on = list(on)
    products = [(F.col("edge_weight") * F.col(c)).alias(c) for c in columns]
    return (
        _meet(features, edges, on, salt)
        .select(*on, "date", "graph", F.col("dst").alias("ticker"), *products)
        .groupBy(*on, "date", "graph", "ticker").agg(*[F.sum(c).alias(c) for c in columns])
    )


def graph_panel(features: DataFrame, edges: Staged, columns: Sequence[str], terms: Sequence[str],
                carry: Sequence[str] = ("pos", "n_dates", "target"), on: Sequence[str] = (),
                runs: Sequence[str] = (), salt: int = 16, by_date: bool = False) -> DataFrame:
    """Feature panel for a list of graph terms: columns <term>_<x>, in one join and one aggregation.

    `edges` must contain the identity graph `self` for every node (and every run): it carries target
    and position and supplies a node's own features, so no second join brings them back. `on` are keys
    shared with the features, `runs` keys that only the edges have (alternative graphs of one term).
    A term without a neighbour is 0; a node without a row of its own on a date gets none.
    """
    own = F.col("graph") == SELF
    aggs = [F.max(F.when(own, F.col(c))).alias(c) for c in carry]
    for t in terms:
        here = F.col("graph") == t
        aggs += [F.coalesce(F.sum(F.when(here, F.col("edge_weight") * F.col(c))), F.lit(0.0)).alias(f"{t}_{c}") for c in columns]
    out = _meet(features, edges, list(on), salt, by_date).groupBy(*on, *runs, "date", F.col("dst").alias("ticker")).agg(*aggs)
    return out.filter(F.col(carry[0]).isNotNull())


def term_columns(terms: Sequence[str], columns: Sequence[str]) -> list[str]:
    return [f"{t}_{c}" for t in terms for c in columns]


def cross_moments(panel: DataFrame, value: str, group: Sequence[str], block: int = 256, chunk: int = 256) -> DataFrame:
    """Sums over dates for every pair of tickers: (group..., src, dst, n, sx, sy, sxy) with src <= dst.

    Values are taken less their ticker's mean over the panel, so covariances from these sums lose no digits to a ticker's level.
    A blocked matrix product. Tickers are cut into blocks of `block` names, dates into chunks of
    `chunk`; one task multiplies two blocks over one chunk (at most 2 * block * chunk cells) and emits
    one row per pair, and the rows are summed over the chunks. No date ever emits its pairs as rows.
    Needs `pos` and no missing cells.
    """
    group = list(group)
    names = number_rows(panel.groupBy("ticker").agg(F.avg(value).alias("level")), "ticker", "i")
    block_of = Staged(names.table.select("ticker", "level", F.floor(F.col("i") / block).cast("int").alias("blk")), names.rows)
    n_blocks = -(-names.rows // block)
    cells = attach(panel.select(*group, "pos", "ticker", F.col(value).alias("x")), block_of, ["ticker"])
    cells = cells.withColumn("x", F.col("x") - F.col("level")).drop("level").withColumn("chunk", F.floor(F.col("pos") / chunk).cast("int"))
    # A block meets itself and every other block; the task key is the ordered pair of blocks.
    paired = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumns({
        "bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")})
    schema = ", ".join([f"`{g}` {panel.schema[g].dataType.simpleString()}" for g in group]
                       + ["src string", "dst string", "n long", "sx double", "sy double", "sxy double"])

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = key[len(group)], key[len(group) + 1]
        left = pdf[pdf.blk == bi].pivot(index="pos", columns="ticker", values="x").sort_index()
        right = left if bi == bj else pdf[pdf.blk == bj].pivot(index="pos", columns="ticker", values="x").sort_index()
        a, b = left.to_numpy(), right.to_numpy()
        i, j = np.triu_indices(a.shape[1]) if bi == bj else map(np.ravel, np.indices((a.shape[1], b.shape[1])))
        out = {g: [key[k]] * len(i) for k, g in enumerate(group)}
        out |= {"src": left.columns.to_numpy()[i], "dst": right.columns.to_numpy()[j], "n": len(left),
                "sx": a.sum(0)[i], "sy": b.sum(0)[j], "sxy": (a.T @ b)[i, j]}
        return pd.DataFrame(out)

    keys = [*group, "bi", "bj", "chunk"]
    parts = spread(paired, *keys).groupBy(*keys).applyInPandas(multiply, schema)
    return parts.groupBy(*group, "src", "dst").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])


def covariances(moments: DataFrame) -> DataFrame:
    """Population covariance per pair from `cross_moments`."""
    n = F.col("n")
    return moments.withColumn("cov", F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n))


def correlations(moments: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Correlation per pair (src < dst): diagonal entries supply the variances."""
    cov = covariances(moments)
    var = cov.filter("src = dst")
    return (
        cov.filter("src < dst")
        .join(var.select(*group, "src", F.col("cov").alias("v_src")), [*group, "src"])
        .join(var.select(*group, F.col("dst"), F.col("cov").alias("v_dst")), [*group, "dst"])
        .select(*group, "src", "dst", (F.col("cov") / F.sqrt(F.col("v_src") * F.col("v_dst"))).alias("corr"))
    )
