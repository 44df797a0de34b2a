"""Long panels: (date, ticker, value...) on a dense date x ticker grid.

Every time window here partitions by ticker. After the per-cell aggregation a ticker holds at most
one row per calendar date, so a group is bounded by the calendar however many raw rows it had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from volarium.functions.scalars import finite_or_null
from volarium.session import attach, stage


# Cells of the dense grid that one task lays out, on average.
GRID_ROWS = 500_000


def by_ticker() -> WindowSpec:
    """A ticker's rows in calendar order."""
    return Window.partitionBy("ticker").orderBy("pos")


def melt(wide: DataFrame, ids: Sequence[str] = ("date",), value: str = "value") -> DataFrame:
    """Wide to long: every column that is not an id is a ticker."""
    tickers = sorted(c for c in wide.columns if c not in ids)
    long = wide.unpivot(list(ids), tickers, "ticker", value)
    return long.withColumn(value, finite_or_null(F.col(value).cast("double")))


def widen(panel: DataFrame, tickers: Sequence[str], value: str = "value", by: Sequence[str] = ("date",)) -> DataFrame:
    """Long to wide with the ticker columns in sorted order; cells without a row are NULL."""
    return panel.groupBy(*by).pivot("ticker", sorted(tickers)).agg(F.first(value))


def calendar_array(panel: DataFrame) -> Column:
    """All dates of the panel in order, as one scalar array (its size is the length of the calendar)."""
    dates = panel.select("date").distinct()
    return dates.agg(F.sort_array(F.collect_list("date")).alias("calendar")).scalar()


def calendar(panel: DataFrame) -> DataFrame:
    """One row per date with its 0-based position."""
    one = panel.sparkSession.range(1).select(F.posexplode(calendar_array(panel)).alias("pos", "date"))
    return one.select("date", "pos")


def densify(panel: DataFrame, values: Sequence[str] = ("value",)) -> DataFrame:
    """Complete the date x ticker grid; missing cells become rows with NULL values.

    Only the observed cells and one marker per ticker are shuffled, by ticker. Behind that exchange a
    marker expands to the whole scalar calendar and meets its ticker's cells in one aggregation, so the
    grid itself never moves, no join is planned, and every later window over ticker reuses the
    partitioning. Adds `pos` (0-based date position) and `n_dates`.

    The exchange carries the observed cells, by whose bytes AQE would size the tasks; a grid beyond `GRID_ROWS` cells is therefore
    dealt to as many tasks as its own (estimated) size asks for.
    """
    tickers, days = panel.agg(F.approx_count_distinct("ticker"), F.approx_count_distinct("date")).first()
    tasks = -(-tickers * days // GRID_ROWS)
    dealt = [max(tasks, int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")))] if tasks > 1 else []
    dates = panel.select("date").distinct().agg(F.sort_array(F.collect_list("date")).alias("d"))
    slots = dates.select(F.transform("d", lambda d, i: F.struct(d.alias("date"), i.alias("pos"))).alias("s")).scalar()
    cells = panel.select("ticker", "date", *[F.col(v).cast("double").alias(v) for v in values])
    markers = panel.select("ticker").distinct().select(
        "ticker", F.lit(None).cast("date").alias("date"), *[F.lit(None).cast("double").alias(v) for v in values])
    itself = F.array(F.struct(F.col("date").alias("date"), F.lit(None).cast("int").alias("pos")))
    return (
        cells.filter("date IS NOT NULL").unionByName(markers)
        .repartition(*dealt, "ticker")
        .select("ticker", *values, F.explode(F.when(F.col("date").isNull(), slots).otherwise(itself)).alias("slot"))
        .groupBy("ticker", F.col("slot.date").alias("date"))
        .agg(F.max("slot.pos").alias("pos"), *[F.max(v).alias(v) for v in values])
        .withColumn("n_dates", F.size(slots))
    )


def forward_fill(dense: DataFrame, *values: str) -> DataFrame:
    """Last known value per ticker; NULLs before the first observation stay."""
    w = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def backward_fill(dense: DataFrame, *values: str) -> DataFrame:
    w = by_ticker().rowsBetween(0, Window.unboundedFollowing)
    return dense.withColumns({v: F.first(v, ignorenulls=True).over(w) for v in values})


def fill_all(dense: DataFrame, *values: str, constant: float = 0.0) -> DataFrame:
    """Forward fill, then backward fill, then a constant for tickers without any value."""
    filled = backward_fill(forward_fill(dense, *values), *values)
    return filled.withColumns({v: F.coalesce(v, F.lit(constant)) for v in values})


def shift(dense: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """Move along the table's dates: positive k looks back, negative k ahead."""
    move = F.lag(column, k) if k >= 0 else F.lead(column, -k)
    return dense.withColumn(name, move.over(by_ticker()))


def log_returns(dense: DataFrame, value: str = "value", name: str = "ret") -> DataFrame:
    """Log difference to the previous date of the calendar."""
    return dense.withColumn(name, F.log(value) - F.log(F.lag(value).over(by_ticker())))


def standardise(panel: DataFrame, column: str, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Centre and scale by the group's mean and population deviation; a constant group becomes 0."""
    stats = stage(panel.groupBy(*by).agg(F.avg(column).alias("centre"), F.stddev_pop(column).alias("spread")), "spread")
    scaled = F.when(F.col("spread") > 0, (F.col(column) - F.col("centre")) / F.col("spread")).otherwise(F.col(column) - F.col("centre"))
    return attach(panel, stats, list(by), "left").withColumn(column, scaled).drop("centre", "spread")


def until(panel: DataFrame, last_date: str) -> DataFrame:
    return panel.filter(F.col("date") <= F.lit(last_date).cast("date"))


def between(panel: DataFrame, first: str, end: str, closed: bool = False) -> DataFrame:
    """[first, end) by default, [first, end] when `closed`."""
    d, e = F.col("date"), F.lit(end).cast("date")
    return panel.filter((d >= F.lit(first).cast("date")) & ((d <= e) if closed else (d < e)))


def select_universe(panel: DataFrame, members: DataFrame, exclude: bool = False) -> DataFrame:
    """Keep (or drop) the tickers listed in `members(ticker)`."""
    return panel.join(members.select("ticker").distinct(), "ticker", "left_anti" if exclude else "left_semi")


def drop_incomplete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Infinities to NULL, then drop rows with any NULL among `columns`."""
    clean = df.withColumns({c: finite_or_null(c) for c in columns})
    return clean.dropna("any", subset=list(columns))


def drop_empty_dates(panel: DataFrame, value: str = "value") -> DataFrame:
    """Drop a date on which no ticker has a value."""
    keep = panel.groupBy("date").agg(F.count(value).alias("n")).filter("n > 0")
    return panel.join(keep.select("date"), "date", "left_semi")


def drop_empty_tickers(panel: DataFrame, value: str = "value") -> DataFrame:
    """Drop a ticker that has no value on any date of the panel given."""
    keep = panel.groupBy("ticker").agg(F.count(value).alias("n")).filter("n > 0")
    return panel.join(keep.select("ticker"), "ticker", "left_semi")


def complete_dates(panel: DataFrame, *values: str) -> DataFrame:
    """Dates on which every ticker has every value (tickers counted over the whole panel)."""
    n_tickers = panel.select("ticker").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    whole = F.count(F.when(F.greatest(*[F.col(v).isNull().cast("int") for v in values], F.lit(0)) == 0, 1))
    keep = panel.groupBy("date").agg(whole.alias("n")).filter(F.col("n") == n_tickers)
    return panel.join(keep.select("date"), "date", "left_semi")


def outer_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer equi-join for a handful of wide tables; long tables need only a union."""
    return left.join(right, list(on), "outer")


def common_keys(panels: Sequence[DataFrame], key: str) -> DataFrame:
    keys = panels[0].select(key).distinct()
    for p in panels[1:]:
        keys = keys.intersect(p.select(key))
    return keys


def align(panels: Sequence[DataFrame]) -> list[DataFrame]:
    """Restrict every panel to the dates and tickers that all of them share."""
    dates, tickers = common_keys(panels, "date"), common_keys(panels, "ticker")
    return [p.join(dates, "date", "left_semi").join(tickers, "ticker", "left_semi") for p in panels]


def split_position(q: float, part: str = "n_dates") -> Column:
    """Number of leading dates that belong to the first `q` of the calendar."""
    return F.floor(F.col(part) * F.lit(q)).cast("int")


def split_by_fraction(dense: DataFrame, q: float) -> tuple[DataFrame, DataFrame]:
    """Leading share of dates for training, the rest for testing."""
    cut = split_position(q)
    return dense.filter(F.col("pos") < cut), dense.filter(F.col("pos") >= cut)


def trim(dense: DataFrame, head: int = 0, tail: int = 0) -> DataFrame:
    """Cut dates off both ends by position."""
    return dense.filter((F.col("pos") >= head) & (F.col("pos") < F.col("n_dates") - tail))


def every_kth(dense: DataFrame, first: int, step: int) -> DataFrame:
    """Every `step`-th date from position `first` on: the forecast origins."""
    return dense.filter((F.col("pos") >= first) & (F.pmod(F.col("pos") - first, F.lit(step)) == 0))
