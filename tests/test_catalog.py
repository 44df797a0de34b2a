"""A spread of registered queries against their SQL on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical
from volarium.plans.catalog import CATALOG

SAMPLE = ["dense_grid", "feature_panel", "complete_dates", "align_panels", "wide_csv_scan", "quote_directory_scan", "realised_variance",
          "percentiles_by_refinement", "return_correlations", "graph_feature_panel", "random_bernoulli_graphs", "har_forecast_losses",
          "ols_coefficients", "fixed_effects_forecast", "rolling_har", "forecast_floors", "regime_losses", "average_ranks",
          "confidence_set_by_ticker", "effect_decomposition", "score_gnn_2l"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in TABLES.split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, con, name):
    mine, theirs = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs) and len(mine) > 0


def test_nation_sums_do_not_depend_on_the_join(spark, sf):
    from volarium.plans import tables

    for cells, column in ((tables.nation_cells, "value"), (tables.order_cells, "ordered")):
        a, b = (cells(spark, sf, max_rows=n).orderBy("date", "ticker").toPandas() for n in (500_000, 0))
        assert a[["date", "ticker"]].equals(b[["date", "ticker"]]) and abs(a[column] - b[column]).max() < 1e-9


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["ticker", "mse", "qlike", "n"] and out.count() > 0


def test_every_inventory_line_is_covered():
    covered = {k for e in CATALOG.values() for k in e.covers.split()}
    lines = ([f"S{i}" for i in range(1, 11)] + [f"P{i}" for i in range(1, 18)] + [f"J{i}" for i in range(1, 13)]
             + [f"A{i}" for i in range(1, 22)] + [f"W{i}" for i in range(1, 16)] + [f"O{i}" for i in range(1, 5)]
             + [f"U{i}" for i in range(1, 5)] + [f"M{i}" for i in range(1, 26)] + ["M1a", "M5a", "M12a"])
    assert [k for k in lines if k not in covered] == []


def test_names_are_plain():
    assert all(re.fullmatch(r"[a-z][a-z0-9_]+", n) for n in CATALOG)
