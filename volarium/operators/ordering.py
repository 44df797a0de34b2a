"""Numbering and running totals over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volarium.session import Staged, attach, stage

# Up to this many rows a plain window in one task is cheaper than the two-step form.
ONE_TASK_ROWS = 100_000


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str,
                  one_task_rows: int = ONE_TASK_ROWS) -> Staged:
    """Sum of `value` over the rows of the same keys that sort before a row by `order` (unique within keys).

    The table is range-partitioned on (keys, order) and written with its range number. Each range adds
    up its own rows; the sums of earlier ranges, a table of ranges x keys, supply the offset.
    """
    keys = list(keys)
    ranges = stage(df.repartitionByRange(*keys, order).withColumn("range", F.spark_partition_id()), "ranges")
    upto = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if ranges.rows <= one_task_rows:
        w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order)
        return Staged(ranges.table.withColumn(name, upto(w)).drop("range"), ranges.rows)
    sums = ranges.table.groupBy(*keys, "range").agg(F.sum(value).alias(value))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("range")
    offsets = stage(sums.select(*keys, "range", upto(before).alias("offset")), "offsets")
    inside = Window.partitionBy(*keys, "range").orderBy(order)
    out = attach(ranges.table, offsets, [*keys, "range"]).withColumn(name, upto(inside) + F.col("offset"))
    return Staged(out.drop("range", "offset"), ranges.rows)


def number_rows(df: DataFrame, order: str, name: str, one_task_rows: int = ONE_TASK_ROWS) -> Staged:
    """0-based position of every row by `order` (unique)."""
    numbered = running_total(df.withColumn("one", F.lit(1).cast("long")), [], order, "one", name, one_task_rows)
    return Staged(numbered.table.drop("one"), numbered.rows)
