"""Queries: panels that pass through files and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from volarium.functions.scalars import rounded
from volarium.operators import gnn, graph
from volarium.plans import sqlkit as q
from volarium.plans import tables as t
from volarium.plans.registry import query
from volarium.session import scratch_path, stage
from volarium.sources import scans, sinks


def nation_names(spark, sf):
    """Names of a dimension table with 25 rows."""
    return [r.n_name for r in t.read(spark, sf, "nation").select("n_name").collect()]


WIDE_SQL = f"""WITH {q.nation_cells()}, d AS (SELECT DISTINCT date FROM cells)
SELECT CAST(d.date AS VARCHAR) AS date, n_name AS ticker, {q.rnd('value', 'value')}
FROM d CROSS JOIN nation LEFT JOIN cells ON cells.date = d.date AND ticker = n_name"""


@query("S1 S5 S6 S7 P4 O4", WIDE_SQL)
def wide_csv_scan(spark, sf):
    path = sinks.wide_csv(t.nation_cells(spark, sf), nation_names(spark, sf), scratch_path(spark, "wide"))
    return scans.wide_csv(spark, path).select(t.text_date(), "ticker", rounded("value").alias("value"))


@query("S2", WIDE_SQL)
def dated_csv_scan(spark, sf):
    path = sinks.wide_csv(t.nation_cells(spark, sf), nation_names(spark, sf), scratch_path(spark, "dated"), date_format="dd/MM/yyyy")
    return scans.wide_csv(spark, path, date_format="dd/MM/yyyy").select(t.text_date(), "ticker", rounded("value").alias("value"))


@query("S4", "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1")
def headerless_csv_scan(spark, sf):
    path = sinks.csv_table(t.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"),
                           scratch_path(spark, "plain"), header=False)
    rows = scans.headerless_csv(spark, path, "key long, priority string, price double")
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("price"), 2).alias("total"))


@query("S10 M12a", f"""WITH {q.nation_dense()}, {q.features('nested')}
SELECT CAST(date AS VARCHAR) AS date, ticker, round(d, 9) + 0.0 AS yhat FROM features""")
def labelled_arrays(spark, sf):
    feats = stage(t.nation_features(spark, sf).table, "features").table
    nodes = graph.number_nodes(feats)
    arrays = gnn.bucket_tensors(feats, nodes, ["d", "w", "m"], size=8)  # several arrays a date
    first = F.transform("x", lambda v: v.getItem(0)).alias("yhat")
    return gnn.label_buckets(arrays.select("date", "bucket", first, "present"), nodes, size=8).select(
        t.text_date(), "ticker", rounded("yhat").alias("yhat"))


@query("S9 S7", f"""WITH {q.nation_dense()}, {q.features('nested')}
SELECT 'HAR_iden' AS model_key, CAST(date AS VARCHAR) AS date, ticker, round(d, 9) + 0.0 AS value FROM features
UNION ALL SELECT 'GHAR_iden+glasso', CAST(date AS VARCHAR), ticker, round(w, 9) + 0.0 FROM features""")
def result_file_discovery(spark, sf):
    """Result files named by run key, found by name parts; a file of another horizon is left out."""
    feats, root = t.nation_features(spark, sf).table, scratch_path(spark, "results")
    names = nation_names(spark, sf)
    for key, column, horizon in (("HAR_iden", "d", 1), ("GHAR_iden+glasso", "w", 1), ("HAR_iden", "m", 5)):
        wide = feats.groupBy("date").pivot("ticker", sorted(names)).agg(F.first(column)).orderBy("date")
        sinks.csv_table(wide, f"{root}/Forecast_Var_{key}_NATIONS_W22_F{horizon}_pred.csv")
    found = scans.result_files(spark, root, "NATIONS", 1).filter(F.col("value").isNotNull())
    return found.select("model_key", t.text_date(), "ticker", rounded("value").alias("value"))


@query("S9 S7", f"""WITH {q.nation_dense()}, {q.features('nested')}
SELECT version, 'HAR_iden' AS model_key, CAST(date AS VARCHAR) AS date, ticker, round(CASE version WHEN 'Forecast_Var' THEN d ELSE w END, 9) + 0.0 AS value
FROM features, (VALUES ('Forecast_Var'), ('Refit_Var')) v(version) WHERE version = 'Forecast_Var' OR ticker > 'C'""")
def result_manifest_versions(spark, sf):
    """Two versions in one folder, the second with fewer columns and in the opposite order, read through one manifest."""
    feats, root = stage(t.nation_features(spark, sf).table, "features").table, scratch_path(spark, "results")
    names = sorted(nation_names(spark, sf))
    for version, column, some in (("Forecast_Var", "d", names), ("Refit_Var", "w", [n for n in names if n > "C"][::-1])):
        wide = feats.groupBy("date").pivot("ticker", some).agg(F.first(column)).orderBy("date")
        sinks.csv_table(wide.select("date", *some), f"{root}/{version}_HAR_iden_NATIONS_W22_F1_pred.csv")
        sinks.csv_table(wide.select("date", *some), f"{root}/{version}_HAR_iden_NATIONS_W22_F5_pred.csv")
    found = scans.read_manifest(spark, scans.result_manifest(spark, root, "NATIONS", 1, versions=["Forecast_Var", "Refit_Var"]))
    return found.filter(F.col("value").isNotNull()).select("version", "model_key", t.text_date(), "ticker", rounded("value").alias("value"))
