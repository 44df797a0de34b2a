"""Connected components of an edge table by alternating large and small stars.

Each step is two grouped minima and a join, written to the shared folder, so lineage stays short and a lost executor
re-reads files. A centre with very many neighbours is a partially aggregated minimum and an ordinary join, which
adaptive execution splits; nothing of the graph reaches the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volarium.session import stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of an edge (a, b) reaches. Nodes without edges are absent."""
    now = stage(edges.select("a", "b").where("a <> b").distinct(), label).table
    before = _signature(now)
    while before[0]:
        now = stage(_small_star(_large_star(now)).distinct(), label).table
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
