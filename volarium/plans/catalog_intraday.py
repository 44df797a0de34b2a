"""Queries: ticks to returns, cleaning, resampling and realised variance."""

from __future__ import annotations

from pyspark.sql import functions as F

from volarium.functions.scalars import mid_price, relative_spread, rounded
from volarium.operators import intraday, panel
from volarium.plans import sqlkit as q
from volarium.plans import tables as t
from volarium.plans.registry import query
from volarium.session import scratch_path, stage
from volarium.sources import scans, sinks

TICKS = "ticks AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, ts, event_id, value AS price FROM events)"
QUOTES = """quotes AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, strftime(ts, '%H:00') AS time,
         max_by(value, (ts, event_id)) AS bid_1, max_by(value * (1 + (user_id % 12) / 20.0), (ts, event_id)) AS ask_1
  FROM events GROUP BY 1, 2, 3)"""
RETURNS = f"""{TICKS},
rets AS (SELECT * FROM (
  SELECT ticker, date, ts, ln(price) - ln(lag(price) OVER w) AS ret, row_number() OVER w - 1 AS rn
  FROM ticks WINDOW w AS (PARTITION BY ticker, date ORDER BY ts, event_id)) WHERE rn > 0)"""
BLOCKS = f"""{RETURNS},
blocks AS (SELECT ticker, date, (rn - 1) // 5 AS block, sum(ret) AS ret, max_by(ts, rn) AS ts, count(*) AS n_rows FROM rets GROUP BY 1, 2, 3)"""
WINSOR = f"""{BLOCKS},
scaled AS (SELECT ticker, date, block, ret * 100 AS ret FROM blocks),
bounds AS (SELECT ticker, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM scaled GROUP BY 1),
clipped AS (SELECT ticker, date, block, least(greatest(ret, lo), hi) AS ret FROM scaled JOIN bounds USING (ticker))"""
DATE = "CAST(date AS VARCHAR) AS date"


def tick_returns(spark, sf):
    return intraday.log_return_by_day(t.ticks(spark, sf), tie=["event_id"])


def blocks(spark, sf):
    return intraday.resample_blocks(tick_returns(spark, sf), 5)


def clipped_blocks(spark, sf):
    scaled = stage(blocks(spark, sf).withColumn("ret", F.col("ret") * 100), "blocks").table
    return intraday.winsorise(scaled, ["ticker"], "ret")


@query("P1 S3", f"""WITH {QUOTES}
SELECT ticker, {DATE}, time, round((bid_1 + ask_1) / 2, 6) + 0.0 AS price, round(abs(ask_1 / bid_1 - 1), 6) + 0.0 AS spread FROM quotes""")
def quote_directory_scan(spark, sf):
    path = sinks.quote_folders(t.hourly_quotes(spark, sf), scratch_path(spark, "quotes"))
    quotes = scans.quote_files(spark, path, ticker_pattern=r"ticker=([^/]+)/")
    return quotes.select("ticker", t.text_date(), "time", rounded(mid_price("bid_1", "ask_1"), 6).alias("price"),
                         rounded(relative_spread("bid_1", "ask_1"), 6).alias("spread"))


def _sane_sql(keep_wide):
    spread = "" if keep_wide else "AND max(abs(ask_1 / bid_1 - 1)) < 0.5"
    return f"""WITH {QUOTES}, good AS (
  SELECT ticker, date FROM quotes GROUP BY 1, 2
  HAVING count(*) = 24 AND strftime(date, '%m-%d') NOT IN ('07-03', '12-24') {spread})
SELECT ticker, {DATE}, time, round((bid_1 + ask_1) / 2, 6) + 0.0 AS price FROM quotes JOIN good USING (ticker, date)"""


def _sane(spark, sf, policy):
    good = intraday.sane_days(stage(t.hourly_quotes(spark, sf), "quotes").table, 24, on_wide_spread=policy)
    return good.select("ticker", t.text_date(), "time", rounded(mid_price("bid_1", "ask_1"), 6).alias("price"))


@query("P8 P1", _sane_sql(True))
def sane_days_keep_wide(spark, sf):
    return _sane(spark, sf, "keep")


@query("P8", f"""WITH {QUOTES}
SELECT ticker, CAST(quotes.date AS VARCHAR) AS date, count(*) AS n, round(max(abs(ask_1 / bid_1 - 1)), 6) + 0.0 AS spread,
       count(*) >= 20 AND strftime(quotes.date, '%m-%d') NOT IN ('07-03', '12-24') AS full_day
FROM quotes GROUP BY ticker, quotes.date""")
def day_checks(spark, sf):
    return t.hourly_quotes(spark, sf).groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.max(relative_spread("bid_1", "ask_1")), 6).alias("spread")).select(
        "ticker", t.text_date(), "n", "spread",
        ((F.col("n") >= 20) & ~F.date_format("date", "MM-dd").isin("07-03", "12-24")).alias("full_day"))


@query("P8 W1", f"""WITH narrow AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, strftime(ts, '%H:00') AS time,
         max_by(value, ts) AS bid_1, max_by(value * (1 + (user_id % 12) / 25.0), ts) AS ask_1
  FROM events GROUP BY 1, 2, 3),
good AS (SELECT ticker, date FROM narrow GROUP BY 1, 2
  HAVING count(*) = 24 AND strftime(date, '%m-%d') NOT IN ('07-03', '12-24') AND max(abs(ask_1 / bid_1 - 1)) < 0.5)
SELECT * FROM (SELECT ticker, CAST(date AS VARCHAR) AS date, time,
  round(ln((bid_1 + ask_1) / 2) - ln(lag((bid_1 + ask_1) / 2) OVER (PARTITION BY ticker, date ORDER BY time)), 6) + 0.0 AS ret
  FROM narrow JOIN good USING (ticker, date)) WHERE ret IS NOT NULL""")
def sane_day_returns(spark, sf):
    # Narrower asks than the other quote queries, so that whole days pass the spread check.
    e = t.read(spark, sf, "events")
    ask = F.col("value") * (1 + F.pmod("user_id", F.lit(12)) / 25)
    quotes = e.select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"),
                      F.date_trunc("hour", "ts").alias("hour"), "ts", F.col("value").alias("bid"), ask.alias("ask")) \
        .groupBy("ticker", "date", "hour").agg(F.max_by("bid", "ts").alias("bid_1"), F.max_by("ask", "ts").alias("ask_1"))
    good = intraday.sane_days(stage(quotes, "quotes").table, 24, on_wide_spread="drop")
    rets = intraday.log_return_by_day(good.withColumn("price", mid_price("bid_1", "ask_1")), order="hour")
    return rets.select("ticker", t.text_date(), F.date_format("hour", "HH:00").alias("time"), rounded("ret", 6).alias("ret"))


@query("W1", f"""WITH {RETURNS}
SELECT ticker, {DATE}, CAST(rn AS BIGINT) AS rn, round(ret, 6) + 0.0 AS ret FROM rets""")
def log_returns_by_day(spark, sf):
    return tick_returns(spark, sf).select("ticker", t.text_date(), "rn", rounded("ret", 6).alias("ret"))


@query("A3", f"""WITH {BLOCKS}
SELECT ticker, {DATE}, CAST(block AS BIGINT) AS block, round(ret, 6) + 0.0 AS ret, strftime(ts, '%H:%M:%S') AS last_time, n_rows FROM blocks""")
def resample_blocks(spark, sf):
    return blocks(spark, sf).select("ticker", t.text_date(), "block", rounded("ret", 6).alias("ret"),
                                    F.date_format("ts", "HH:mm:ss").alias("last_time"), "n_rows")


@query("A4", f"""WITH {BLOCKS}
SELECT ticker, {', '.join(f'round(quantile_cont(ret, {p}), 6) + 0.0 AS p{i}' for i, p in enumerate((0.005, 0.25, 0.5, 0.995)))} FROM blocks GROUP BY 1""")
def exact_percentiles(spark, sf):
    p = intraday.exact_percentiles(stage(blocks(spark, sf), "blocks").table, ["ticker"], "ret", [0.005, 0.25, 0.5, 0.995]).table
    return p.select("ticker", *[rounded(f"p{i}", 6).alias(f"p{i}") for i in range(4)])


@query("A4", f"""WITH {TICKS}
SELECT ticker, {', '.join(f'round(quantile_cont(price, {p}), 6) + 0.0 AS p{i}' for i, p in enumerate((0.01, 0.5, 0.9)))} FROM ticks GROUP BY 1""")
def percentiles_by_refinement(spark, sf):
    # A coarse sketch, whose brackets are narrow next to the groups of any table.
    p = intraday.exact_percentiles(t.ticks(spark, sf), ["ticker"], "price", [0.01, 0.5, 0.9], accuracy=50).table
    return p.select("ticker", *[rounded(f"p{i}", 6).alias(f"p{i}") for i in range(3)])


@query("P12 P2", f"""WITH {WINSOR}
SELECT ticker, {DATE}, CAST(block AS BIGINT) AS block, round(ret, 6) + 0.0 AS ret FROM clipped""")
def winsorised_returns(spark, sf):
    return clipped_blocks(spark, sf).select("ticker", t.text_date(), "block", rounded("ret", 6).alias("ret"))


@query("A1 A2 P2 P12 A3 W1", f"""WITH {WINSOR}
SELECT ticker, {DATE}, round(sum(ret), 5) + 0.0 AS daily_ret, round(sum(ret * ret), 3) + 0.0 AS rv FROM clipped GROUP BY ticker, date""")
def realised_variance(spark, sf):
    daily = intraday.daily_moments(clipped_blocks(spark, sf))
    return daily.select("ticker", t.text_date(), rounded("daily_ret", 5).alias("daily_ret"), rounded("rv", 3).alias("rv"))


@query("A2 W7 W3 T5", f"""WITH {WINSOR}, cells AS (
  SELECT ticker, date, sum(ret * ret) / 1e4 AS value, sum(ret) AS exog FROM clipped GROUP BY ticker, date),
{q.DENSE}, {q.FILLED}
SELECT ticker, {DATE}, round(value, 6) + 0.0 AS rv, round({q.lag_mean('value', 1, 5)}, 6) + 0.0 AS week,
  round(CASE WHEN count(value) OVER a = 5 THEN sum(value) OVER a END, 6) + 0.0 AS next5
FROM dense WINDOW a AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def variance_horizons(spark, sf):
    from volarium.operators import har

    daily = intraday.daily_moments(clipped_blocks(spark, sf)).select("ticker", "date", (F.col("rv") / 1e4).alias("value"))
    dense = panel.forward_fill(panel.densify(stage(daily, "daily").table), "value")
    out = har.forward_sum(dense.withColumn("week", har.lag_mean("value", 1, 5)), "value", 5, "next5")
    return out.select("ticker", t.text_date(), rounded("value", 6).alias("rv"), rounded("week", 6).alias("week"),
                      rounded("next5", 6).alias("next5"))


def minute_cells(spark, sf):
    """(date, time, ticker, value): the highest price of every minute in which an asset trades; most assets lack most minutes."""
    e = t.ticks(spark, sf).withColumn("time", F.date_format("ts", "HH:mm"))
    return e.groupBy("date", "time", "ticker").agg(F.max("price").alias("value"))


@query("A3 J1", """WITH cells AS (SELECT CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS time, event_type AS ticker, max(value) AS value FROM events GROUP BY 1, 2, 3),
minutes AS (SELECT date, time, (row_number() OVER (PARTITION BY date ORDER BY time) - 1) // 5 AS block FROM (SELECT DISTINCT date, time FROM cells)),
blocks AS (SELECT date, block, max(time) AS time, count(*) AS n_minutes FROM minutes GROUP BY 1, 2),
sums AS (SELECT date, block, ticker, sum(value) AS value FROM cells JOIN minutes USING (date, time) GROUP BY 1, 2, 3)
SELECT CAST(b.date AS VARCHAR) AS date, b.block, b.time, b.n_minutes, t.ticker, round(s.value, 6) + 0.0 AS value
FROM blocks b CROSS JOIN (SELECT DISTINCT ticker FROM cells) t LEFT JOIN sums s ON s.date = b.date AND s.block = b.block AND s.ticker = t.ticker""")
def merged_panel_resample(spark, sf):
    """Blocks of five rows of the merged panel, the same minutes for every asset."""
    out = intraday.resample_panel(stage(minute_cells(spark, sf), "minutes").table, 5)
    return out.select(t.text_date(), "block", "time", "n_minutes", "ticker", rounded("value", 6).alias("value"))


@query("J1 U1", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, strftime(ts, '%H:%M') AS time, """ + ", ".join(
    f"round(max(value) FILTER (event_type = '{k}'), 6) + 0.0 AS {k}" for k in ("click", "error", "purchase", "signup", "view"))
    + " FROM events GROUP BY 1, 2")
def merged_minutes(spark, sf):
    cells = minute_cells(spark, sf)
    names = sorted(r[0] for r in t.ticks(spark, sf).select("ticker").distinct().collect())
    wide = panel.widen(cells, names, by=("date", "time"))
    return wide.select(t.text_date(), "time", *[rounded(f"`{n}`", 6).alias(n) for n in names])
