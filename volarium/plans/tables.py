"""The panels that the registered queries derive from the driver tables.

Ticks come from `events` (asset = event type). Weekly panels come from `lineitem` with the supplier as
asset, so the number of assets grows with the data; graph queries use the supplier's nation, a universe
of fixed size like a stock index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from volarium.operators.graph import edges_from_list, identity_edges, normalise, number_nodes, ring_pairs
from volarium.operators.har import har_panel
from volarium.operators.panel import densify, forward_fill
from volarium.session import BROADCAST_ROWS, Staged, attach, stage


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is inferred once per process and path, its data never kept."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), "ts", "event_id", F.col("value").alias("price"))


def hourly_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last bid and ask of every hour that has a tick, both of one event; a full day has 24 rows."""
    e = read(spark, sf_dir, "events")
    ask = F.col("value") * (1 + F.pmod("user_id", F.lit(12)) / 20)
    quote, place = F.struct("bid", "ask"), F.struct("ts", "event_id")
    return (
        e.select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"),
                 F.date_format("ts", "HH:00").alias("time"), "ts", "event_id", F.col("value").alias("bid"), ask.alias("ask"))
        .groupBy("ticker", "date", "time")
        .agg(F.max_by(quote, place).alias("last"))
        .select("ticker", "date", "time", F.col("last.bid").alias("bid_1"), F.col("last.ask").alias("ask_1"))
    )


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, value, exog) per week and supplier."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
                      F.col("l_suppkey").cast("string").alias("ticker")).agg(
        (F.sum("l_extendedprice") / 1e5).alias("value"), (F.sum("l_quantity") / 1e2).alias("exog"))


def by_nation(facts: DataFrame, members: DataFrame, nations: DataFrame, sums: dict[str, str],
              max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Sums per (date, nation) of facts (key, date, ...) over members (key, nation key).

    While the members (counted) may be broadcast, the facts meet them in place and only nation sums are
    shuffled. Beyond that the facts are first reduced per key and date, so that a key with a large share
    of the rows reaches the join as one row per date.
    """
    names = members.join(nations, "nation").select("key", F.col("name").alias("ticker"))
    aggs = [F.sum(c).alias(c) for c in sums]
    small = Staged(names, members.count())
    if small.rows > max_rows:
        facts = facts.groupBy("key", "date").agg(*aggs)
    joined = attach(facts, small, ["key"], max_rows=max_rows)
    return joined.groupBy("date", "ticker").agg(*[F.expr(e).alias(n) for n, e in sums.items()])


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))


def nation_cells(spark: SparkSession, sf_dir: str, unit: str = "week", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(date, ticker, value, exog) per week or day and supplier nation."""
    facts = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date"),
        F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("exog"))
    members = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return by_nation(facts, members, nations(spark, sf_dir), {"value": "sum(value) / 1e5", "exog": "sum(exog) / 1e2"}, max_rows)


def order_cells(spark: SparkSession, sf_dir: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(date, ticker, ordered): weekly order value per customer nation."""
    facts = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"),
        F.col("o_totalprice").alias("ordered"))
    members = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return by_nation(facts, members, nations(spark, sf_dir), {"ordered": "sum(ordered) / 1e5"}, max_rows)


def dense_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward_fill(densify(stage(supplier_cells(spark, sf_dir), "cells").table, ["value", "exog"]), "value", "exog")


def dense_nations(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    return forward_fill(densify(stage(nation_cells(spark, sf_dir, unit), "cells").table, ["value", "exog"]), "value", "exog")


def supplier_features(spark: SparkSession, sf_dir: str, har: str = "nested", exog: str | None = None) -> Staged:
    return stage(har_panel(dense_suppliers(spark, sf_dir), har=har, exog=exog), "features")


def nation_features(spark: SparkSession, sf_dir: str, unit: str = "week", har: str = "nested",
                    exog: str | None = None) -> Staged:
    return stage(har_panel(dense_nations(spark, sf_dir, unit), har=har, exog=exog), "features")


def lag_forecasts(features: DataFrame) -> DataFrame:
    """Three forecasts to score: the last value, the 5-date mean and the 22-date mean."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("yhat"))
                      for m, c in (("DAY", "d"), ("WEEK", "w"), ("MONTH", "m"))])
    return features.select("date", "pos", "n_dates", "ticker", "target", "d", F.explode(pairs).alias("p")) \
        .select("date", "pos", "n_dates", "ticker", "target", "d", "p.model", "p.yhat")


def ring_graph(features: DataFrame, reach: int = 2) -> Staged:
    """Identity plus the normalised ring over the tickers of a panel."""
    nodes = number_nodes(features)
    ring = normalise(edges_from_list(ring_pairs(nodes, reach), "ring"))
    return stage(identity_edges(nodes.table).unionByName(ring), "edges")


def text_date(column: str = "date"):
    return F.col(column).cast("string").alias(column)
