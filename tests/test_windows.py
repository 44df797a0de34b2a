"""Pair moments of moving windows against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volarium.operators import windows

SPANS = [(20, 0, 20), (27, 7, 27), (34, 14, 34), (50, 0, 50), (60, 40, 60)]


@pytest.fixture(scope="module")
def pdf():
    """Seven tickers at a level of 1e6; D is listed late, E misses every third date, F has one value, G has no sound one."""
    rng = np.random.default_rng(6)
    common = rng.normal(size=60)
    rows = []
    for k, t in enumerate("ABCDEFG"):
        for d in range(60):
            if (t == "D" and d < 30) or (t == "E" and d % 3 == 0) or (t == "F" and d != 45):
                continue
            rows.append((d, t, float("nan") if t == "G" else 1e6 * k + common[d] * (k + 1) + rng.normal()))
    return pd.DataFrame(rows + [(3, "A2", None)], columns=["pos", "ticker", "ret"])


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame([(o, s, e) for o, s, e in SPANS], "origin int, s_pos int, o_pos int")


@pytest.mark.parametrize("block,chunk", [(256, 256), (2, 7), (3, 60)])
def test_window_moments(spark, pdf, spans, block, chunk):
    panel = spark.createDataFrame(pdf, "pos int, ticker string, ret double").repartition(6)
    got = windows.window_correlations(windows.window_moments(panel, "ret", spans, block, chunk)).collect()
    want = {}
    for o, s, e in SPANS:
        wide = pdf[(pdf.pos >= s) & (pdf.pos < e) & pdf.ret.notna()].pivot(index="pos", columns="ticker", values="ret")
        corr = wide.corr()
        for i, a in enumerate(wide.columns):
            for b in wide.columns[i + 1:]:
                n = int((wide[a].notna() & wide[b].notna()).sum())
                if n:
                    want[o, a, b] = (n, corr.loc[a, b])
    assert {(r.origin, r.src, r.dst) for r in got} == set(want)
    for r in got:
        n, c = want[r.origin, r.src, r.dst]
        assert r.n == n and (r["corr"] is None if c != c or n < 2 else r["corr"] == pytest.approx(c, abs=1e-9))
    assert not any("D" in (r.src, r.dst) for r in got if r.origin == 20) and any("D" in (r.src, r.dst) for r in got if r.origin == 34)


def test_a_row_is_used_once_however_many_windows_cover_it(spark, pdf, spans):
    panel = spark.createDataFrame(pdf, "pos int, ticker string, ret double")
    segments, bounds = windows.cut_segments(spans)
    cuts = [(r["first"], r.end) for r in segments.table.orderBy("segment").collect()]
    assert cuts == [(0, 7), (7, 14), (14, 20), (20, 27), (27, 34), (34, 40), (40, 50), (50, 60)]
    assert {r.origin: (r.low, r.high) for r in bounds.table.collect()} == {20: (0, 3), 27: (1, 4), 34: (2, 5), 50: (0, 7), 60: (6, 8)}
    whole = windows.segment_moments(panel, "ret", segments).where("src = dst").agg(F.sum("n")).first()[0]
    assert whole == pdf.ret.notna().sum()


def test_correlation_graph(spark):
    rows = [(1, "A", "B", 40, 0.5), (1, "A", "C", 40, -0.5), (1, "B", "C", 40, 0.2), (1, "A", "D", 10, 0.9), (1, "B", "D", 40, None)]
    edges = windows.correlation_graph(spark.createDataFrame(rows, "origin int, src string, dst string, n long, corr double"), 0.5, 30)
    assert sorted((r.src, r.dst, r.w) for r in edges.collect()) == [("A", "B", 1.0), ("A", "C", 1.0), ("B", "A", 1.0), ("C", "A", 1.0)]


def test_no_rows(spark, spans):
    assert windows.window_moments(spark.createDataFrame([], "pos int, ticker string, ret double"), "ret", spans).count() == 0
