"""Ticks to daily realised variance.

A single (ticker, day) may hold a large share of all ticks, so nothing here windows over it whole.
Days are cut into time slices; what a slice needs from earlier ones (rows before it, last price) is
a small aggregate per slice, and the full-size windows run inside slices only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volarium.functions.scalars import relative_spread
from volarium.operators.ordering import running_total
from volarium.session import Staged, attach, stage

# First slice length, and the largest slice (in rows) that one task should sort.
SLICE_SECONDS = 3600
SLICE_ROWS = 2_000_000
# Relative accuracy (as 1 / ACCURACY) of the sketch that brackets a percentile before it is counted exactly.
ACCURACY = 2000


def _slice(order: str, seconds: int) -> Column:
    """Number of a wall-clock slice; grows with time and does not depend on the session time zone."""
    day = F.unix_date(F.to_date(order)) * 86_400
    return F.floor((day + F.hour(order) * 3600 + F.minute(order) * 60 + F.second(order)) / seconds)


def _shorter(seconds: int, fullest: int, slice_rows: int) -> int:
    return max(1, seconds // (-(-fullest // slice_rows) + 1))


def slice_length(ticks: DataFrame, keys: Sequence[str], order: str, seconds: int = SLICE_SECONDS,
                 slice_rows: int = SLICE_ROWS) -> int:
    """Shorten the slices until the fullest one, counted, fits a task (or lasts one second)."""
    return _slices(ticks, keys, order, None, (), seconds, slice_rows)[0]


def _slices(ticks: DataFrame, keys: Sequence[str], order: str, value: str | None, tie: Sequence[str], seconds: int, slice_rows: int) -> tuple[int, DataFrame]:
    """The slice length that fits, and the written aggregate of its slices: (keys, slice, n, last_value).

    One scan, and one more each time the slices have to be shorter; the aggregate that is counted is the one that is used.
    """
    last = [F.max_by(value, F.struct(order, *tie)).alias("last_value")] if value else []
    while True:
        per_slice = stage(ticks.groupBy(*keys, _slice(order, seconds).alias("slice")).agg(F.count(F.lit(1)).alias("n"), *last), "slices", fullest=F.max("n"))
        fullest = per_slice.seen["fullest"] or 0
        if fullest <= slice_rows or seconds == 1:
            return seconds, per_slice.table
        seconds = _shorter(seconds, fullest, slice_rows)


def day_order(ticks: DataFrame, keys: Sequence[str], order: str, value: str,
              slice_seconds: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Add `rn` (1-based row number) and `prev` (previous value) within `keys` by `order`, equal times by the `tie` columns.

    Same result as `row_number` and `lag` over (keys ORDER BY order, tie), but the sort is per time slice.
    Each slice gets one seed row carrying the row count and the last value of the slices before it,
    so the ticks shuffle once and no join touches them. Two scans: one for the slices, one for the rows.
    """
    keys = list(keys)
    seconds, per_slice = _slices(ticks, keys, order, value, tie, slice_seconds or SLICE_SECONDS, SLICE_ROWS if slice_seconds is None else 1 << 62)
    sliced = ticks.withColumn("slice", _slice(order, seconds))
    before = Window.partitionBy(*keys).orderBy("slice")
    seeds = per_slice.select(
        *keys, "slice", F.lit(0).alias("kind"),
        F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.lag("last_value").over(before).alias(value))
    rows = sliced.withColumns({"kind": F.lit(1), "offset": F.lit(None).cast("long")})
    w = Window.partitionBy(*keys, "slice").orderBy("kind", order, *tie)
    numbered = rows.unionByName(seeds, allowMissingColumns=True).withColumns({
        "rn": F.row_number().over(w) - 1 + F.first("offset").over(w),
        "prev": F.lag(value).over(w),
    })
    return numbered.filter("kind = 1").drop("kind", "offset", "slice")


def log_return_by_day(ticks: DataFrame, price: str = "price", order: str = "ts",
                      slice_seconds: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """ln(p_t) - ln(p_{t-1}) within (ticker, date); the first tick of a day has no return and is dropped.

    `rn` numbers the remaining rows of the day from 1.
    """
    ordered = day_order(ticks, ["ticker", "date"], order, price, slice_seconds, tie)
    return (
        ordered.filter("rn > 1")
        .withColumns({"ret": F.log(price) - F.log("prev"), "rn": F.col("rn") - 1})
        .drop("prev")
    )


def sane_days(quotes: DataFrame, rows_per_day: int, skip_days: Sequence[str] = ("07-03", "12-24"),
              max_spread: float = 0.5, on_wide_spread: str = "drop",
              bid: str = "bid_1", ask: str = "ask_1") -> DataFrame:
    """Keep (ticker, date) groups with exactly `rows_per_day` quotes outside the half-day list.

    A day with any relative spread of `max_spread` or more is kept or dropped by `on_wide_spread`.
    """
    checks = quotes.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("n"), F.max(relative_spread(bid, ask)).alias("spread"))
    good = checks.filter((F.col("n") == rows_per_day) & ~F.date_format("date", "MM-dd").isin(list(skip_days)))
    if on_wide_spread == "drop":
        good = good.filter(F.col("spread") < max_spread)
    elif on_wide_spread != "keep":
        raise ValueError(f"on_wide_spread must be 'keep' or 'drop', found {on_wide_spread!r}")
    return quotes.join(good.select("ticker", "date"), ["ticker", "date"], "left_semi")


def resample_blocks(numbered: DataFrame, k: int = 5, value: str = "ret", label: str = "ts") -> DataFrame:
    """k consecutive rows of a day to one: sum (all-NULL stays NULL) under the last row's label.

    A trailing block with fewer than k rows is kept under its own last label.
    """
    block = F.floor((F.col("rn") - 1) / k)
    return (
        numbered.groupBy("ticker", "date", block.alias("block"))
        .agg(F.sum(value).alias(value), F.max_by(label, "rn").alias(label), F.count(F.lit(1)).alias("n_rows"))
    )


def daily_moments(intraday: DataFrame, ret: str = "ret") -> DataFrame:
    """Daily return (sum) and realised variance (sum of squares) in one aggregation."""
    return intraday.groupBy("ticker", "date").agg(
        F.sum(ret).alias("daily_ret"), F.sum(F.pow(ret, F.lit(2.0))).alias("rv"))


def _interpolate(lower: Column, upper: Column, rank: Column) -> Column:
    """The built-in aggregate's formula; infinite neighbours are never multiplied by a zero weight."""
    share = rank - F.floor(rank)
    return F.when((share == 0) | (lower == upper), lower).otherwise((1 - share) * lower + share * upper)


def _brackets(data: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int, reach: float) -> Staged:
    """(keys, n, lo, hi): per key the row count and for every probability values around its order statistics.

    One scan with the built-in mergeable quantile sketch. Its ranks are off by at most n / accuracy, so bounds taken `reach` to either side hold the
    wanted ranks; where that is less than three ranks, or reaches an end, a bound is left open. NaN takes part as infinity,
    the place next to it.
    """
    asked = [min(max(q, 0.0), 1.0) for p in probs for q in (p - reach, p + reach)]
    sketched = F.when(F.isnan("x"), F.lit(float("inf"))).otherwise(F.col("x"))
    sketch = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(sketched, asked, accuracy).alias("at"))
    narrow = F.col("n") * reach < 3
    inf = float("inf")
    lo = [F.lit(-inf) if p - reach <= 0 else F.when(narrow, F.lit(-inf)).otherwise(F.get("at", F.lit(2 * i))) for i, p in enumerate(probs)]
    hi = [F.lit(inf) if p + reach >= 1 else F.when(narrow, F.lit(inf)).otherwise(F.get("at", F.lit(2 * i + 1))) for i, p in enumerate(probs)]
    return stage(sketch.select(*keys, "n", F.array(*lo).alias("lo"), F.array(*hi).alias("hi")), "percentile-brackets")


def _order_statistics(data: DataFrame, keys: Sequence[str], brackets: Staged, probs: Sequence[float]) -> Staged:
    """(keys, rank, at__, kind__): the value at every wanted rank; kind__ 1 if it was counted, else the bracket missed the rank.

    One scan: rows inside a bracket are counted by value, all others by the gap between brackets that they lie in. A running total
    in value order over these counts, range-partitioned, places them.
    """
    x, inf = F.col("x"), F.lit(float("inf"))
    bound = [(F.get("lo", F.lit(i)), F.get("hi", F.lit(i))) for i in range(len(probs))]
    inside = F.lit(False)
    for lo, hi in bound:
        inside = inside | ((x >= lo) & ((x <= hi) | (hi == inf)))
    next_lo = F.array_min(F.array(*[F.when(x < lo, lo) for lo, _ in bound]))
    place = F.when(inside, F.struct(x.alias("at__"), F.lit(1).alias("kind__"))).when(next_lo.isNotNull(), F.struct(next_lo.alias("at__"), F.lit(0).alias("kind__"))) \
        .otherwise(F.struct(F.lit(float("nan")).alias("at__"), F.lit(2).alias("kind__")))
    counts = attach(data, brackets, keys).groupBy(*keys, place.alias("place__")).agg(F.count(F.lit(1)).alias("count"))
    placed = running_total(counts, keys, "place__", "count", "below").table
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("n") - 1) * F.lit(p)), F.ceil((F.col("n") - 1) * F.lit(p))) for p in probs])))
    wanted = attach(placed, Staged(brackets.table.select(*keys, ranks.alias("ranks")), brackets.rows), keys)
    hits = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("count")))
    return stage(wanted.select(*keys, F.explode(hits).alias("rank"), "place__.at__", "place__.kind__"), "order-statistics", missed=F.count(F.when(F.col("kind__") != 1, 1)))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY) -> Staged:
    """Linearly interpolated percentiles per key, ignoring NULLs: (keys..., p0, p1, ...).

    Two scans whatever the size of a group: a sketch brackets the wanted order statistics, then the rows inside the brackets are
    counted by value. The counts prove that a bracket holds its rank; should one not, all brackets are widened and
    counted again. No group is gathered in a task. NaN ranks above infinity.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull())
    reach = 2 / accuracy
    while True:
        brackets = _brackets(data, keys, probs, accuracy, reach)
        found = _order_statistics(data, keys, brackets, probs)
        if not found.seen["missed"]:
            break
        reach *= 8
    at = found.table.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("rank", "at__"))).alias("at"))
    out = attach(at, Staged(brackets.table.select(*keys, "n"), brackets.rows), keys)
    return Staged(out.select(*keys, *[
        _interpolate(F.element_at("at", F.floor((F.col("n") - 1) * F.lit(p))),
                     F.element_at("at", F.ceil((F.col("n") - 1) * F.lit(p))),
                     (F.col("n") - 1) * F.lit(p)).alias(f"p{i}")
        for i, p in enumerate(probs)]), brackets.rows)


def number_minutes(cells: DataFrame, by: Sequence[str] = ("date",), time: str = "time") -> Staged:
    """(by, time, rn): the distinct times at which any ticker has a cell, numbered from 1 within `by`."""
    minutes = cells.select(*by, time, F.lit(1).cast("long").alias("one")).distinct()
    numbered = running_total(minutes, by, time, "one", "before")
    return Staged(numbered.table.select(*by, time, (F.col("before") + 1).alias("rn")), numbered.rows)


def resample_panel(cells: DataFrame, k: int = 5, value: str = "value", by: Sequence[str] = ("date",), time: str = "time") -> DataFrame:
    """k consecutive rows of the merged panel to one: (by, block, time, n_minutes, ticker, value).

    A row of the merged panel is a time at which any ticker has a cell, so all tickers share one numbering and a block covers the same
    minutes for each of them, whether a ticker has a cell in every minute or in none. A value is the sum over the ticker's cells
    (all-NULL stays NULL, as does a ticker without cells in a block), under the block's last time. A trailing block of a day with
    fewer than k rows is kept under its own last time. With an empty `by` blocks run on from day to day, if times sort across days.

    Numbering and blocks are tables over the calendar; the cells meet them by a counted join. The grid of blocks and tickers joins the
    cells as rows without a value, so one aggregation adds up cells and completes the grid.
    """
    by = list(by)
    minutes = number_minutes(cells, by, time)
    blocked = stage(minutes.table.select(*by, time, F.floor((F.col("rn") - 1) / k).alias("block")), "minute-blocks")
    tickers = cells.select("ticker").distinct().agg(F.array_sort(F.collect_list("ticker")).alias("tickers")).scalar()
    blocks = blocked.table.groupBy(*by, "block").agg(F.max(time).alias(time), F.count(F.lit(1)).alias("n_minutes"))
    grid = blocks.withColumn("ticker", F.explode(tickers)).withColumn(value, F.lit(None).cast("double"))
    rows = attach(cells.select(*by, time, "ticker", F.col(value).cast("double").alias(value)), blocked, [*by, time]).drop(time)
    both = rows.unionByName(grid, allowMissingColumns=True)
    return both.groupBy(*by, "block", "ticker").agg(F.max(time).alias(time), F.max("n_minutes").alias("n_minutes"), F.sum(value).alias(value)).select(
        *by, "block", time, "n_minutes", "ticker", value)


def winsorise(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.005, high: float = 0.995,
              accuracy: int = ACCURACY) -> DataFrame:
    """Pull values outside the two percentiles of their key back to them; NULL stays NULL."""
    bounds = exact_percentiles(df, keys, value, [low, high], accuracy)
    joined = attach(df, bounds, list(keys), "left")
    clipped = F.when(F.col(value) > F.col("p1"), F.col("p1")).when(F.col(value) < F.col("p0"), F.col("p0"))
    return joined.withColumn(value, clipped.otherwise(F.col(value))).drop("p0", "p1")
