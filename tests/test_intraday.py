import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volarium.operators import intraday
from volarium.operators.ordering import number_rows, running_total
from volarium.sources import scans, universes


@pytest.fixture(scope="module")
def pdf():
    """One ticker holds most of the ticks, all within two hours."""
    rng = np.random.default_rng(1)
    rows = []
    for ticker, n in (("HOT", 600), ("COLD", 40)):
        for day in (1, 2):
            secs = np.sort(rng.choice(7200, n, replace=False))
            rows += [(ticker, dt.date(2024, 5, day), dt.datetime(2024, 5, day, 9) + dt.timedelta(seconds=int(s)), float(p))
                     for s, p in zip(secs, rng.lognormal(0, 0.1, n))]
    return pd.DataFrame(rows, columns=["ticker", "date", "ts", "price"])


@pytest.fixture(scope="module")
def ticks(spark, pdf):
    return spark.createDataFrame(pdf, "ticker string, date date, ts timestamp_ntz, price double")


@pytest.mark.parametrize("seconds", [1, 60, 3600, 86400])
def test_sliced_order_equals_plain_window(ticks, pdf, seconds):
    got = intraday.log_return_by_day(ticks, slice_seconds=seconds).toPandas().sort_values(["ticker", "ts"])
    want = pdf.sort_values(["ticker", "ts"]).copy()
    want["ret"] = np.log(want.price).groupby([want.ticker, want.date]).diff()
    want["rn"] = want.groupby(["ticker", "date"]).cumcount()
    want = want.dropna()
    assert got.rn.tolist() == want.rn.tolist()
    np.testing.assert_allclose(got.ret, want.ret, atol=1e-12)


def test_slices_shrink_to_the_hot_key(ticks):
    assert intraday.slice_length(ticks, ["ticker", "date"], "ts", 3600, slice_rows=10_000) == 3600
    short = intraday.slice_length(ticks, ["ticker", "date"], "ts", 3600, slice_rows=40)
    fullest = ticks.groupBy("ticker", "date", intraday._slice("ts", short)).count().agg(F.max("count")).first()[0]
    assert short < 3600 and fullest <= 40


@pytest.mark.parametrize("accuracy", [100_000, 2000, 50, 5, 1])
def test_percentiles_are_exact_at_any_accuracy(ticks, pdf, accuracy):
    probs = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    got = intraday.exact_percentiles(ticks, ["ticker"], "price", probs, accuracy).table.toPandas()
    for _, r in got.iterrows():
        want = np.percentile(pdf[pdf.ticker == r.ticker].price, [100 * p for p in probs])
        np.testing.assert_allclose([r[f"p{i}"] for i in range(len(probs))], want, rtol=1e-12)


def test_percentiles_with_one_dominant_value(spark):
    values = [1.0] * 500 + [2.0] * 10 + [1e9]
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None)], "ticker string, x double")
    got = intraday.exact_percentiles(df, ["ticker"], "x", [0.5, 0.99, 1.0], 40).table.first()
    np.testing.assert_allclose(got[1:], np.percentile(values, [50, 99, 100]))


@pytest.mark.parametrize("accuracy", [2000, 20])
def test_percentiles_with_infinite_values_end(spark, accuracy):
    inf, nan = float("inf"), float("nan")
    groups = {"up": [float(x) for x in range(20)] + [inf], "down": [-inf] * 8 + [float(x) for x in range(20)], "nan": [1.0] * 6 + [nan] * 7,
              "wide": [-1.7e308, 1.7e308] * 6 + [float(x) for x in range(9)], "both": [-inf, inf] * 7, "tiny": [5e-324 * k for k in range(15)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "ticker string, x double")
    got = {r[0]: r[1:] for r in intraday.exact_percentiles(df, ["ticker"], "x", [0.0, 0.5, 1.0], accuracy).table.collect()}
    for k, vs in groups.items():
        ranked = sorted(vs, key=lambda v: (v != v, v))
        n = len(vs) - 1
        low, high = ranked[n // 2], ranked[-(-n // 2)]
        np.testing.assert_array_equal(got[k], [ranked[0], low if low == high else low / 2 + high / 2, ranked[-1]])


def test_tied_ticks_follow_the_tie_column(spark):
    ts = dt.datetime(2024, 1, 2, 10)
    rows = [("k", ts.date(), ts + dt.timedelta(seconds=k // 3), k, float(k + 1)) for k in range(30)]
    df = spark.createDataFrame(rows[::-1], "ticker string, date date, ts timestamp, event_id long, price double")
    got = intraday.day_order(df.repartition(5), ["ticker", "date"], "ts", "price", 2, tie=["event_id"]).orderBy("event_id").collect()
    assert [r["rn"] for r in got] == list(range(1, 31)) and [r["prev"] for r in got] == [None, *map(float, range(1, 30))]


def test_percentile_brackets_leave_most_rows_uncounted(spark):
    """Half the rows in one group: only those near the wanted ranks are counted by value, the rest by gap."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=40_000), np.full(20_000, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"ticker": "hot", "x": x})).repartition(6)
    data = df.select("ticker", "x")
    probs = [0.001, 0.25, 0.5, 0.9]
    brackets = intraday._brackets(data, ["ticker"], probs, 2000, 2 / 2000)
    inside = data.crossJoin(brackets.table.drop("ticker")).where(" OR ".join(f"(x BETWEEN lo[{i}] AND hi[{i}])" for i in range(4))).where("x <> 0.25").count()
    found = intraday._order_statistics(data, ["ticker"], brackets, probs).table.collect()
    ranked = np.sort(x)
    assert inside < 2000 and all(r.kind__ == 1 and r.at__ == ranked[r["rank"]] for r in found) and len(found) == 8
    got = intraday.exact_percentiles(df, ["ticker"], "x", probs).table.first()
    np.testing.assert_allclose(got[1:], np.percentile(x, [100 * p for p in probs]), rtol=1e-12)


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    asked = []
    right = intraday._brackets

    def narrow(data, keys, probs, accuracy, reach):
        asked.append(reach)
        out = right(data, keys, probs, accuracy, reach)
        return out if len(asked) > 1 else intraday.stage(out.table.selectExpr("k", "n", "transform(lo, v -> 1e9D) AS lo", "transform(hi, v -> 2e9D) AS hi"), "wrong")
    monkeypatch.setattr(intraday, "_brackets", narrow)
    df = spark.range(1000).selectExpr("1 AS k", "cast(id AS double) AS x")
    got = intraday.exact_percentiles(df, ["k"], "x", [0.1, 0.5], 100).table.first()
    assert len(asked) == 2 and asked[1] > asked[0] and got[1:] == pytest.approx((99.9, 499.5))


def test_panel_blocks_share_their_minutes(spark):
    """B lacks minutes in every block and the whole second block of the first day; one cell is null."""
    times = [f"{9 + k // 60:02}:{k % 60:02}" for k in range(12)]
    rows = [(d, m, "A", float(k + d)) for d in (1, 2) for k, m in enumerate(times) if not (d == 2 and k == 3)]
    rows += [(d, m, "B", float(10 * k) if k else None) for d in (1, 2) for k, m in enumerate(times) if k % 3 == 0 and not (d == 1 and 5 <= k < 10)]
    df = spark.createDataFrame(rows, "date int, time string, ticker string, value double").repartition(5)
    pdf = pd.DataFrame(rows, columns=["date", "time", "ticker", "value"])
    for by in (["date"], []):
        wide = pdf.assign(at=pdf.time if by else pdf.date.astype(str) + pdf.time).pivot_table(index=[*by, "at"], columns="ticker", values="value", aggfunc="first", dropna=False)
        wide = wide[wide.index.isin(pdf.assign(at=pdf.time if by else pdf.date.astype(str) + pdf.time).set_index([*by, "at"]).index)].sort_index()
        number = wide.groupby(level=0).cumcount() if by else np.arange(len(wide))
        want = wide.groupby([*(wide.index.get_level_values(b) for b in by), number // 5]).sum(min_count=1)
        cells = df if by else df.withColumn("time", F.concat(F.col("date").cast("string"), "time"))
        got = intraday.resample_panel(cells, 5, by=by).toPandas()
        assert len(got) == 2 * len(want)
        for r in got.itertuples():
            value = want.loc[(r.date, r.block) if by else r.block, r.ticker]
            assert (value != value and r.value != r.value) or value == r.value
        assert got.n_minutes.max() == 5
    first = {(r.block, r.ticker): (r.time, r.n_minutes, r.value) for r in intraday.resample_panel(df, 5).where("date = 1").collect()}
    assert first[1, "B"] == ("09:09", 5, None) and first[2, "B"] == ("09:11", 2, None) and first[0, "B"][2] == 30.0 and first[2, "A"] == ("09:11", 2, 23.0)
    assert intraday.resample_panel(df.where("false"), 5).count() == 0


def test_winsorise(ticks, pdf):
    got = intraday.winsorise(ticks, ["ticker"], "price", accuracy=30).toPandas()
    for k, g in pdf.groupby("ticker"):
        lo, hi = np.percentile(g.price, [0.5, 99.5])
        np.testing.assert_allclose(np.sort(got[got.ticker == k].price), np.sort(g.price.clip(lo, hi)))


def test_blocks_of_five(ticks):
    numbered = intraday.log_return_by_day(ticks)
    got = intraday.resample_blocks(numbered).toPandas()
    want = numbered.toPandas().sort_values("rn")
    sums = want.groupby(["ticker", "date", (want.rn - 1) // 5]).ret.sum()
    np.testing.assert_allclose(got.sort_values(["ticker", "date", "block"]).ret, sums, atol=1e-12)
    assert got.n_rows.max() == 5


def test_day_sanity(spark):
    day = lambda d, n, wide=False: [("A", d, f"{i:03}", 10.0, 16.0 if wide and i == 3 else 10.1) for i in range(n)]
    rows = day(dt.date(2020, 7, 1), 391) + day(dt.date(2020, 7, 2), 390) + day(dt.date(2020, 7, 3), 391) + day(dt.date(2020, 7, 6), 391, True)
    q = spark.createDataFrame(rows, "ticker string, date date, time string, bid_1 double, ask_1 double")
    kept = lambda policy: {r.date.day for r in intraday.sane_days(q, 391, on_wide_spread=policy).select("date").distinct().collect()}
    assert kept("drop") == {1} and kept("keep") == {1, 6}
    with pytest.raises(ValueError):
        intraday.sane_days(q, 391, on_wide_spread="x")


def test_quote_files_take_ticker_and_day_from_the_path(spark, tmp_path):
    for ticker, day in (("AAPL", "2011-07-01"), ("IBM", "2011-07-05")):
        (tmp_path / ticker).mkdir()
        (tmp_path / ticker / f"{ticker}_{day}_quotes.csv").write_text("time,bid_1,ask_1\n09:30,10,10.2\n09:31,11,11.2\n")
    got = {(r.ticker, str(r.date), r.time, r.bid_1) for r in scans.quote_files(spark, str(tmp_path)).collect()}
    assert got == {("AAPL", "2011-07-01", "09:30", 10.0), ("AAPL", "2011-07-01", "09:31", 11.0),
                   ("IBM", "2011-07-05", "09:30", 10.0), ("IBM", "2011-07-05", "09:31", 11.0)}


def test_result_names(spark, tmp_path):
    for name, v in (("Forecast_Var_GHAR_iden+glasso_DJIA_W22_F1_pred.csv", 1), ("Forecast_Var_HAR_iden_DJIA_W22_F5_pred.csv", 2)):
        (tmp_path / name).write_text(f"date,A,B\n2020-01-01,{v},\n")
    rows = scans.result_files(spark, str(tmp_path), "DJIA", 1).orderBy("ticker").collect()
    assert [(r.model_key, r.ticker, r.value) for r in rows] == [("GHAR_iden+glasso", "A", 1.0), ("GHAR_iden+glasso", "B", None)]


def test_every_result_file_is_read_by_its_own_header(spark, tmp_path):
    """Two versions, two column orders, a folder of parts, a short line and quoted names side by side."""
    d = "Forecast_Var_GHAR_iden_DJIA_W22_F1_pred.csv"
    (tmp_path / d).write_text('"date","A","B"\n2020-01-01,1,2\n2020-01-02,3\n')
    parts = tmp_path / "Forecast_Var_HAR_iden_DJIA_W22_F1_pred.csv"
    parts.mkdir()
    (parts / "part-0.csv").write_text("date,B,A\n2020-01-01,20,10\n")
    (parts / "part-1.csv").write_text("date,C,A,B\n2020-01-02,x,30,inf\n")
    (tmp_path / "Refit_Var_HAR_iden_DJIA_W22_F1_pred.csv").write_text("date,B\n2020-01-01,-1\n")
    (tmp_path / "Forecast_Var_HAR_iden_DJIA_W22_F5_pred.csv").write_text("date,A\n2020-01-01,99\n")
    (tmp_path / "Forecast_Var_HAR_iden_SP100_W22_F1_pred.csv").write_text("date,A\n2020-01-01,99\n")
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n")
    manifest = scans.result_manifest(spark, str(tmp_path), "DJIA", 1)
    assert sorted((r.version, r.model_key, *r.header) for r in manifest.table.collect()) == [
        ("Forecast_Var", "GHAR_iden", "date", "A", "B"), ("Forecast_Var", "HAR_iden", "date", "B", "A"), ("Forecast_Var", "HAR_iden", "date", "C", "A", "B"), ("Refit_Var", "HAR_iden", "date", "B")]
    got = {(r.version[0] + r.model_key[0], r.date.day, r.ticker): r.value for r in scans.read_manifest(spark, manifest).collect()}
    assert got == {("FG", 1, "A"): 1, ("FG", 1, "B"): 2, ("FG", 2, "A"): 3, ("FG", 2, "B"): None, ("FH", 1, "A"): 10, ("FH", 1, "B"): 20,
                   ("FH", 2, "A"): 30, ("FH", 2, "B"): None, ("FH", 2, "C"): None, ("RH", 1, "B"): -1}
    with pytest.raises(ValueError, match="several versions"):
        scans.result_files(spark, str(tmp_path), "DJIA", 1)
    one = scans.result_files(spark, str(tmp_path), "DJIA", 1, version="Refit_Var").collect()
    assert [(r.model_key, r.ticker, r.value) for r in one] == [("HAR_iden", "B", -1.0)]
    none = scans.result_files(spark, str(tmp_path), "FTSE", 1)
    assert none.count() == 0 and none.columns == ["model_key", "date", "ticker", "value"]


def test_universes(spark):
    assert universes.universe(spark, "DJIA30").count() == 27 and universes.universe(spark, "SP100").count() == 80
    with pytest.raises(ValueError):
        universes.universe(spark, "FTSE")


@pytest.mark.parametrize("limit", [0, 1000])
def test_numbering_in_one_and_in_many_tasks(spark, limit):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"))
    out = number_rows(df, "k", "i", one_task_rows=limit)
    got = [r.k for r in out.table.orderBy("i").collect()]
    assert got == sorted(got) and out.rows == 500
    assert [r.i for r in out.table.orderBy("i").collect()] == list(range(500))
    by = df.withColumn("g", F.substring("k", 1, 1)).withColumn("one", F.lit(1))
    totals = running_total(by, ["g"], "k", "one", "before", one_task_rows=limit).table.toPandas()
    want = totals.sort_values("k").groupby("g").cumcount()
    assert totals.sort_values("k").before.tolist() == want.tolist()


def test_merged_minutes_has_a_column_for_every_event_type(spark, sf, tmp_path):
    from volarium.plans.catalog import CATALOG

    events = spark.read.parquet(f"{sf}/events.parquet")
    more = events.where("event_type = 'click'").limit(5).withColumn("event_type", F.lit("refund.part"))
    events.unionByName(more).write.parquet(f"{tmp_path}/events.parquet")
    got = CATALOG["merged_minutes"].run(spark, str(tmp_path))
    assert got.columns == ["date", "time", "click", "error", "purchase", "refund.part", "signup", "view"] and got.where("`refund.part` is not null").count() > 0
