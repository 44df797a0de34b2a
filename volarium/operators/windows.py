"""Pair moments of many overlapping windows as differences of prefix sums.

The dates are cut at every window's start and end. A segment between two cuts is multiplied out once, as a blocked matrix product of
tickers; running totals over the segments turn the pair sums into prefixes, and a window is the prefix at its end less the one at its
start. A panel row is used once however many windows cover it, and a window costs one subtraction a pair, however long it is.

Cells may be missing: a pair's sums run over the dates on which both tickers have a value, and a pair that has none in a
window, as that of a ticker not listed then, has no row there. Values are taken less their ticker's mean over the panel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volarium.operators.ordering import number_rows
from volarium.session import Staged, attach, spread, stage

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def cut_segments(windows: DataFrame) -> tuple[Staged, Staged]:
    """For windows (origin, s_pos, o_pos), positions [s_pos, o_pos): the segments (segment, first, end) and for every window the
    segments (low, high] that make it up. Both are tables over the calendar."""
    cuts = windows.select(F.explode(F.array("s_pos", "o_pos")).alias("pos")).distinct()
    line = Window.partitionBy(F.lit(1)).orderBy("pos")
    numbered = stage(cuts.select("pos", F.row_number().over(line).alias("segment"), F.lead("pos").over(line).alias("end")), "segment-cuts")
    segments = Staged(numbered.table.where("end IS NOT NULL").select("segment", F.col("pos").alias("first"), "end"), numbered.rows)
    at = lambda c, name: Staged(numbered.table.select(F.col("pos").alias(c), (F.col("segment") - 1).alias(name)), numbered.rows)
    bounds = attach(attach(windows.select("origin", "s_pos", "o_pos"), at("s_pos", "low"), ["s_pos"]), at("o_pos", "high"), ["o_pos"])
    return segments, stage(bounds.where("low < high").select("origin", "low", "high"), "window-bounds")


def segment_moments(panel: DataFrame, value: str, segments: Staged, block: int = 256, chunk: int = 256) -> DataFrame:
    """(segment, src, dst, sums) with src <= dst, over the dates on which both tickers have a value.

    Tickers are cut into blocks of `block` names and a segment into chunks of `chunk` dates; one task multiplies two blocks over one
    chunk, at most 2 * block * chunk cells.
    """
    sound = panel.where(F.col(value).isNotNull() & ~F.isnan(value))
    names = number_rows(sound.groupBy("ticker").agg(F.avg(value).alias("level")), "ticker", "i")
    block_of = Staged(names.table.select("ticker", "level", F.floor(F.col("i") / block).cast("int").alias("blk")), names.rows)
    days = Staged(segments.table.select("segment", F.explode(F.sequence("first", F.col("end") - 1)).alias("pos")), segments.rows)
    days = stage(days.table, "segment-days")
    cells = attach(attach(sound.select("pos", "ticker", F.col(value).alias("x")), block_of, ["ticker"]), days, ["pos"])
    cells = cells.select("segment", F.floor(F.col("pos") / chunk).cast("int").alias("chunk"), "pos", "ticker", "blk", (F.col("x") - F.col("level")).alias("x"))
    n_blocks = -(-names.rows // block)
    paired = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1))))).withColumns({
        "bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")})

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        days_ = np.unique(pdf.pos.to_numpy())
        side = lambda b: pdf[pdf.blk == b].pivot(index="pos", columns="ticker", values="x").reindex(days_)
        left = side(key[1])
        right = left if key[1] == key[2] else side(key[2])
        here, there = (~np.isnan(x.to_numpy()) for x in (left, right))
        a, b = np.nan_to_num(left.to_numpy()), np.nan_to_num(right.to_numpy())
        m, k = here.astype(float), there.astype(float)
        i, j = np.triu_indices(a.shape[1]) if key[1] == key[2] else map(np.ravel, np.indices((a.shape[1], b.shape[1])))
        sums = (m.T @ k, a.T @ k, m.T @ b, (a * a).T @ k, m.T @ (b * b), a.T @ b)
        out = pd.DataFrame({"segment": key[0], "src": left.columns.to_numpy()[i], "dst": right.columns.to_numpy()[j], **{c: s[i, j] for c, s in zip(SUMS, sums)}})
        return out[out.n > 0]

    schema = "segment int, src string, dst string, " + ", ".join(f"{c} double" for c in SUMS)
    parts = spread(paired, "segment", "bi", "bj", "chunk").groupBy("segment", "bi", "bj", "chunk").applyInPandas(multiply, schema)
    return parts.groupBy("segment", "src", "dst").agg(*[F.sum(c).alias(c) for c in SUMS])


def window_moments(panel: DataFrame, value: str, windows: DataFrame, block: int = 256, chunk: int = 256) -> DataFrame:
    """(origin, src, dst, sums) for every window and pair of tickers that share a date in it."""
    segments, bounds = cut_segments(windows)
    moments = stage(segment_moments(panel, value, segments, block, chunk), "segment-moments").table
    # A pair without a row in a segment still has a prefix there.
    none = moments.select("src", "dst").distinct().withColumn("segment", F.explode(F.sequence(F.lit(1), F.lit(max(1, segments.rows - 1))))) \
        .select("segment", "src", "dst", *[F.lit(0.0).alias(c) for c in SUMS])
    upto = Window.partitionBy("src", "dst").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    filled = moments.unionByName(none).groupBy("segment", "src", "dst").agg(*[F.sum(c).alias(c) for c in SUMS])
    prefix = filled.select("segment", "src", "dst", *[F.sum(c).over(upto).alias(c) for c in SUMS])
    ends = bounds.table.select("origin", F.explode(F.array(F.struct(F.col("high").alias("segment"), F.lit(1.0).alias("sign")),
                                                           F.struct(F.col("low").alias("segment"), F.lit(-1.0).alias("sign")))).alias("e")).select("origin", "e.*").where("segment > 0")
    both = attach(prefix, Staged(ends, 2 * bounds.rows), ["segment"])
    out = both.groupBy("origin", "src", "dst").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in SUMS])
    return out.where("n > 0.5").withColumn("n", F.round("n").cast("long"))


def window_correlations(moments: DataFrame) -> DataFrame:
    """(origin, src, dst, n, corr) with src < dst from `window_moments`; a pair without variation has no correlation (NULL)."""
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    return moments.where("src < dst").select("origin", "src", "dst", "n", F.when(var > 0, cov / F.sqrt(F.when(var > 0, var))).alias("corr"))


def correlation_graph(correlations: DataFrame, threshold: float, min_dates: int, graph: str = "correlation") -> DataFrame:
    """Symmetric 0/1 edges (origin, graph, src, dst, w) between tickers whose correlation in a window of at least `min_dates`
    common dates is `threshold` or more in size. A ticker without returns in the window is not part of its graph."""
    near = correlations.where((F.abs("corr") >= threshold) & (F.col("n") >= min_dates))
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return near.select("origin", ends.alias("e")).select("origin", F.lit(graph).alias("graph"), "e.src", "e.dst", F.lit(1.0).alias("w"))
