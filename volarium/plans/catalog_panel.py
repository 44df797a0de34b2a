"""Queries: panel cleaning, filling, alignment, splits, lags and horizons."""

from __future__ import annotations

from pyspark.sql import functions as F

from volarium.functions.scalars import finite_or_null, rounded
from volarium.operators import har, panel
from volarium.plans import sqlkit as q
from volarium.plans import tables as t
from volarium.plans.registry import query
from volarium.session import stage

TEXT = "CAST(date AS VARCHAR) AS date"


def _out(df, *values, keys=("date", "ticker"), digits=9):
    return df.select(*[t.text_date() if k == "date" else k for k in keys], *[rounded(v, digits).alias(v) for v in values])


@query("J8 A16", f"""WITH {q.SUPPLIER_CELLS}, {q.DENSE}
SELECT {TEXT}, ticker, CAST(pos AS BIGINT) AS pos, {q.rnd('value', 'value')} FROM grid""")
def dense_grid(spark, sf):
    dense = panel.densify(stage(t.supplier_cells(spark, sf), "cells").table)
    return dense.select(t.text_date(), "ticker", F.col("pos").cast("long").alias("pos"), rounded("value").alias("value"))


@query("W8", f"WITH {q.SUPPLIER_DENSE} SELECT {TEXT}, ticker, {q.rnd('value', 'value')} FROM dense")
def forward_fill(spark, sf):
    return _out(t.dense_suppliers(spark, sf), "value")


@query("P14 W8", f"""WITH {q.SUPPLIER_DENSE},
back AS (SELECT ticker, date, coalesce(value, first_value(value IGNORE NULLS) OVER (
  PARTITION BY ticker ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS value FROM dense)
SELECT {TEXT}, ticker, {q.rnd('value', 'value')} FROM back""")
def fill_both_ways(spark, sf):
    dense = panel.densify(stage(t.supplier_cells(spark, sf), "cells").table)
    return _out(panel.fill_all(dense, "value"), "value")


@query("P9", f"""WITH {q.SUPPLIER_DENSE},
prev AS (SELECT *, lag(value) OVER (PARTITION BY ticker ORDER BY pos) AS p FROM dense)
SELECT {TEXT}, ticker, {q.rnd('1 / (value - p)', 'inverse_change', 5)}
FROM prev WHERE value <> p AND exog IS NOT NULL""")
def finite_rows(spark, sf):
    d = panel.shift(t.dense_suppliers(spark, sf), "value", 1, "p")
    change = F.col("value") - F.col("p")
    inverse = F.when(change == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), change))
    return _out(panel.drop_incomplete_rows(d.withColumn("inverse_change", inverse), "inverse_change", "exog"), "inverse_change", digits=5)


@query("P10", f"""WITH {q.nation_cells('day')}, {q.DENSE},
known AS (SELECT date, ticker, CASE WHEN exog > 0.4 THEN value END AS value FROM grid),
d AS (SELECT date FROM known GROUP BY 1 HAVING count(value) > 0),
k AS (SELECT ticker FROM known GROUP BY 1 HAVING count(value) > 0)
SELECT {TEXT}, ticker, {q.rnd('value', 'value')} FROM known
WHERE date IN (SELECT date FROM d) AND ticker IN (SELECT ticker FROM k)""")
def drop_empty_slices(spark, sf):
    dense = panel.densify(stage(t.nation_cells(spark, sf, "day"), "cells").table, ["value", "exog"])
    known = dense.withColumn("value", F.when(F.col("exog") > 0.4, F.col("value"))).select("date", "ticker", "value")
    known = stage(known, "known").table
    return _out(panel.drop_empty_tickers(panel.drop_empty_dates(known)), "value")


@query("P11 J10", f"""WITH {q.nation_cells()}, {q.DENSE},
whole AS (SELECT date FROM grid GROUP BY 1 HAVING count(*) = count(value) AND count(*) = count(exog))
SELECT {TEXT}, ticker, {q.rnd('value', 'value')}, {q.rnd('exog', 'exog')} FROM grid WHERE date IN (SELECT date FROM whole)""")
def complete_dates(spark, sf):
    cells = stage(t.nation_cells(spark, sf), "cells").table
    return _out(panel.complete_dates(panel.densify(cells, ["value", "exog"]), "value", "exog"), "value", "exog")


@query("P3", f"""WITH {q.nation_cells()}
SELECT {TEXT}, ticker, {q.rnd('value', 'value')} FROM cells
WHERE ticker IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))
  AND ticker NOT IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')""")
def universe_selection(spark, sf):
    members = t.read(spark, sf, "nation").join(t.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("ticker"), "r_name")
    kept = panel.select_universe(t.nation_cells(spark, sf), members.filter(F.col("r_name").isin("ASIA", "EUROPE")))
    return _out(panel.select_universe(kept, members.filter("r_name = 'EUROPE'"), exclude=True), "value")


@query("P5", f"""WITH {q.SUPPLIER_CELLS}
SELECT {TEXT}, ticker, {q.rnd('value', 'value')} FROM cells WHERE date <= DATE '1999-06-30'""")
def date_cutoff(spark, sf):
    return _out(panel.until(t.supplier_cells(spark, sf), "1999-06-30"), "value")


@query("P6", f"""WITH {q.SUPPLIER_CELLS}
SELECT 'half_open' AS kind, ticker, count(*) AS n, {q.rnd('sum(value)', 'total')} FROM cells
WHERE date >= DATE '1997-01-06' AND date < DATE '1999-01-04' GROUP BY 2
UNION ALL SELECT 'closed', ticker, count(*), round(sum(value), 9) + 0.0 FROM cells
WHERE date >= DATE '1997-01-06' AND date <= DATE '1999-01-04' GROUP BY 2""")
def period_filters(spark, sf):
    cells = t.supplier_cells(spark, sf)
    kinds = [("half_open", False), ("closed", True)]
    parts = [panel.between(cells, "1997-01-06", "1999-01-04", closed).withColumn("kind", F.lit(k)) for k, closed in kinds]
    return parts[0].unionByName(parts[1]).groupBy("kind", "ticker").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("total"))


@query("P7", f"""WITH {q.SUPPLIER_DENSE}
SELECT CASE WHEN pos < floor(n_dates * 0.8) THEN 'train' ELSE 'test' END AS part, ticker,
       count(*) AS n, {q.rnd('avg(value)', 'mean_value')}, CAST(min(date) AS VARCHAR) AS first_date
FROM dense GROUP BY 1, 2""")
def fraction_split(spark, sf):
    train, test = panel.split_by_fraction(t.dense_suppliers(spark, sf), 0.8)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "ticker").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value")).alias("mean_value"),
                                              F.min("date").cast("string").alias("first_date"))


ORDER_CELLS = """order_cells AS (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, n_name AS ticker, sum(o_totalprice) / 1e5 AS ordered
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


@query("J3 U2", f"""WITH {q.nation_cells()}, {ORDER_CELLS}
SELECT 'shipped' AS panel, {TEXT}, ticker, {q.rnd('value', 'value')} FROM cells
WHERE date IN (SELECT date FROM order_cells) AND ticker IN (SELECT ticker FROM order_cells)
UNION ALL SELECT 'ordered', CAST(date AS VARCHAR), ticker, round(ordered, 9) + 0.0 FROM order_cells
WHERE date IN (SELECT date FROM cells) AND ticker IN (SELECT ticker FROM cells)""")
def align_panels(spark, sf):
    shipped = stage(t.nation_cells(spark, sf), "shipped").table
    ordered = stage(t.order_cells(spark, sf), "ordered").table
    a, b = panel.align([shipped, ordered])
    a = _out(a, "value").withColumn("panel", F.lit("shipped"))
    b = _out(b.withColumnRenamed("ordered", "value"), "value").withColumn("panel", F.lit("ordered"))
    return a.unionByName(b)


@query("J1", f"""WITH {q.nation_cells()}, {ORDER_CELLS}
SELECT CAST(coalesce(c.date, o.date) AS VARCHAR) AS date, coalesce(c.ticker, o.ticker) AS ticker,
       {q.rnd('value', 'value')}, {q.rnd('ordered', 'ordered')}
FROM cells c FULL OUTER JOIN order_cells o ON c.date = o.date AND c.ticker = o.ticker""")
def outer_merge(spark, sf):
    return _out(panel.outer_merge(t.nation_cells(spark, sf), t.order_cells(spark, sf), ["date", "ticker"]), "value", "ordered")


@query("J9 J2", f"""WITH {q.nation_cells()}, {ORDER_CELLS}
SELECT CAST(date AS VARCHAR) AS date, ticker, {q.rnd('value', 'value')}, {q.rnd('ordered', 'ordered')}
FROM cells JOIN order_cells USING (date, ticker)""")
def column_concat(spark, sf):
    return _out(t.nation_cells(spark, sf).join(t.order_cells(spark, sf), ["date", "ticker"]), "value", "ordered")


@query("U3", f"""WITH {q.nation_cells('day')}
SELECT CAST(date AS VARCHAR) AS date FROM
(SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def date_difference(spark, sf):
    ship = t.read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    order = t.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return ship.exceptAll(order).select(t.text_date())


@query("U1 U4 A16", """SELECT CAST(date AS VARCHAR) AS date, count(*) AS n_sources FROM (
  SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, 'ship' AS source FROM lineitem
  UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), 'order' FROM orders) GROUP BY 1""")
def stacked_dates(spark, sf):
    ship = t.read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    order = t.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return ship.unionByName(order).groupBy("date").agg(F.count(F.lit(1)).alias("n_sources")).select(t.text_date(), "n_sources")


@query("W2", f"""WITH {q.SUPPLIER_DENSE}
SELECT {TEXT}, ticker, round(lag(value, 3) OVER w, 9) + 0.0 AS lag3, round(lead(value, 2) OVER w, 9) + 0.0 AS lead2
FROM dense WINDOW w AS (PARTITION BY ticker ORDER BY pos)""")
def lag_and_lead(spark, sf):
    d = panel.shift(panel.shift(t.dense_suppliers(spark, sf), "value", 3, "lag3"), "value", -2, "lead2")
    return _out(d, "lag3", "lead2")


@query("W9 W10 P6", f"""WITH {q.nation_dense('day')}
SELECT {TEXT}, ticker, CAST(pos AS BIGINT) AS pos, {q.rnd('value', 'value')} FROM dense
WHERE pos >= 22 AND pos < n_dates - 4 AND (pos - 22) % 22 = 0""")
def origin_dates(spark, sf):
    d = panel.every_kth(panel.trim(t.dense_nations(spark, sf, "day"), 22, 4), 22, 22)
    return _out(d.withColumn("pos", F.col("pos").cast("long")), "value", keys=("date", "ticker", "pos"))


def _har_sql(kind, extra=""):
    cols = ", ".join(f"{q.lag_mean('value', a, b, kind == 'partial')} AS {n}" for n, (a, b) in q.SPANS[kind].items())
    return f"""WITH {q.SUPPLIER_DENSE}, h AS (SELECT date, ticker, pos, {cols} FROM dense)
SELECT {TEXT}, ticker, {q.rnd('d', 'd')}, {q.rnd('w', 'w')}, {q.rnd('m', 'm')} FROM h"""


@query("W3", _har_sql("nested"))
def har_nested(spark, sf):
    return _out(har.har_features(t.dense_suppliers(spark, sf), har="nested"), "d", "w", "m")


@query("W4", _har_sql("disjoint"))
def har_disjoint(spark, sf):
    return _out(har.har_features(t.dense_suppliers(spark, sf), har="disjoint"), "d", "w", "m")


@query("W5", _har_sql("partial").replace("(value)", "(ln(value))"))
def har_partial(spark, sf):
    logs = t.dense_suppliers(spark, sf).withColumn("value", F.log("value"))
    return _out(har.har_features(logs, har="partial"), "d", "w", "m")


@query("W6", f"""WITH {q.SUPPLIER_DENSE},
h AS (SELECT date, ticker, {', '.join(f"CASE WHEN pos < {b} THEN 0.0 ELSE {q.lag_mean('value', a, b)} END AS {n}" for n, (a, b) in q.SPANS['nested'].items())} FROM dense)
SELECT {TEXT}, ticker, {q.rnd('d', 'd')}, {q.rnd('w', 'w')}, {q.rnd('m', 'm')} FROM h""")
def har_zero_warmup(spark, sf):
    return _out(har.har_features(t.dense_suppliers(spark, sf), warmup="zero"), "d", "w", "m")


@query("W3 J2 P9 A16", f"""WITH {q.SUPPLIER_DENSE}, {q.features('nested', exog=True)}
SELECT {TEXT}, ticker, {', '.join(q.rnd(c, c) for c in ('target', 'd', 'w', 'm', 'iv_d', 'iv_w', 'iv_m'))} FROM features""")
def feature_panel(spark, sf):
    return _out(har.har_panel(t.dense_suppliers(spark, sf), exog="exog"), "target", "d", "w", "m", "iv_d", "iv_w", "iv_m")


@query("W7", f"""WITH {q.SUPPLIER_DENSE}
SELECT {TEXT}, ticker,
  round(CASE WHEN count(value) OVER a = 5 THEN sum(value) OVER a END, 9) + 0.0 AS sum5,
  round(CASE WHEN count(value) OVER b = 3 THEN avg(value) OVER b END, 9) + 0.0 AS mean3
FROM dense WINDOW a AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING),
                  b AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
def forward_horizons(spark, sf):
    d = har.forward_sum(t.dense_suppliers(spark, sf), "value", 5, "sum5")
    return _out(har.forward_mean(d, "value", 3, "mean3"), "sum5", "mean3")


@query("W7 P9 P11", f"""WITH {q.nation_dense()},
h AS (SELECT date, ticker, CASE WHEN count(value) OVER a = 5 THEN sum(value) OVER a END AS target
      FROM dense WINDOW a AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
whole AS (SELECT date FROM h GROUP BY 1 HAVING count(*) = count(target))
SELECT {TEXT}, ticker, {q.rnd('target', 'target')}, {q.rnd('target / 5', 'per_day')} FROM h WHERE date IN (SELECT date FROM whole)""")
def horizon_panel(spark, sf):
    d = stage(har.forward_sum(t.dense_nations(spark, sf), "value", 5).select("date", "ticker", "target"), "horizon").table
    return _out(panel.complete_dates(d, "target").withColumn("per_day", F.col("target") / 5), "target", "per_day")


@query("S5 S6 P4 A16", """WITH cells AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, r_name AS ticker, sum(l_extendedprice) / 1e5 AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT CAST(date AS VARCHAR) AS date, """ + ", ".join(
    f"round(max(CASE WHEN ticker = '{r}' THEN value END), 9) + 0.0 AS {r.lower().replace(' ', '_')}"
    for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    + " FROM cells GROUP BY 1")
def long_to_wide(spark, sf):
    cells = t.nation_cells(spark, sf).join(
        t.read(spark, sf, "nation").join(t.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_name").alias("ticker"), "r_name"), "ticker")
    by_region = cells.groupBy("date", F.col("r_name").alias("ticker")).agg(F.sum("value").alias("value"))
    names = sorted(r[0] for r in t.read(spark, sf, "region").select("r_name").distinct().collect())
    wide = panel.widen(by_region, names)
    return wide.select(t.text_date(), *[rounded(f"`{n}`").alias(n.lower().replace(" ", "_")) for n in names])


@query("S5", """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, ticker, round(sum(value) / 1e3, 9) + 0.0 AS value
FROM lineitem, LATERAL (VALUES ('discount', l_discount), ('quantity', l_quantity), ('tax', l_tax)) v(ticker, value)
GROUP BY 1, 2""")
def wide_to_long(spark, sf):
    li = t.read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_discount").alias("discount"),
                                              F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return panel.melt(li).groupBy("date", "ticker").agg(rounded(F.sum("value") / 1e3).alias("value")) \
        .select(t.text_date(), "ticker", "value")


@query("J4", f"""WITH {q.nation_cells()}, latest AS (SELECT ticker, max_by(value, date) AS value FROM cells GROUP BY 1)
SELECT n_name AS ticker, round(coalesce(value, 0), 9) + 0.0 AS value FROM nation LEFT JOIN latest ON n_name = ticker""")
def reindex_with_zero(spark, sf):
    latest = t.nation_cells(spark, sf).groupBy("ticker").agg(F.max_by("value", "date").alias("value"))
    labels = t.read(spark, sf, "nation").select(F.col("n_name").alias("ticker"))
    return labels.join(latest, "ticker", "left").select("ticker", rounded(F.coalesce("value", F.lit(0.0))).alias("value"))


@query("A11 T24", f"""WITH {q.SUPPLIER_DENSE}
SELECT {TEXT}, ticker, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0.0 AS value FROM dense WINDOW w AS (PARTITION BY ticker)""")
def standardised_panel(spark, sf):
    dense = stage(t.dense_suppliers(spark, sf).select("date", "ticker", "value"), "dense").table
    return _out(panel.standardise(dense, "value"), "value", digits=6)


@query("W4", f"""WITH {q.nation_dense()},
h AS (SELECT date, ticker, {', '.join(f"{q.lag_mean('value', a + 1, b + 1)} AS {n}" for n, (a, b) in q.SPANS['disjoint'].items())} FROM dense)
SELECT {TEXT}, ticker, {q.rnd('d', 'd')}, {q.rnd('w', 'w')}, {q.rnd('m', 'm')} FROM h""")
def har_with_gap(spark, sf):
    return _out(har.har_features(t.dense_nations(spark, sf), har="disjoint", gap=1), "d", "w", "m")
