"""Session construction, staged tables and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side with more rows than this is never broadcast by `attach`.
BROADCAST_ROWS = 500_000


def local_session(cores: str | int = "*", app: str = "volarium", partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        # The co-moments of a Gram over ten columns or more pass the default limit, beyond which nothing is compiled.
        .config("spark.sql.codegen.maxFields", "1000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder of its own, because there every task sees the same disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="volarium-"))
    return spark.sparkContext.getCheckpointDir()


@dataclass(frozen=True)
class Staged:
    """A table written once to the shared folder, with the row count and other figures taken during the write."""

    table: DataFrame
    rows: int
    seen: dict[str, Any] = field(default_factory=dict)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's own folder, so that a finished application's tables go in one piece."""
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **figures: Column) -> Staged:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads the files instead of re-running the raw scan),
    lets several consumers share one computation, and gives Catalyst real file sizes for its own
    join choice. The rows are counted while writing, without a second job, as are other aggregates, given by name.
    """
    path = scratch_path(df.sparkSession, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()]).write.parquet(path)
    found = seen.get
    return Staged(df.sparkSession.read.schema(df.schema).parquet(path), int(found["rows"]), {n: found[n] for n in figures})


def attach(big: DataFrame, small: Staged, on: list[str], how: str = "inner",
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join that broadcasts the staged side only when its counted rows stay under `max_rows`.

    Beyond the limit it is a merge join: both sides shuffle on the key and AQE splits skewed
    partitions. Without the hint Spark might broadcast `big`, which it takes for small behind a generator.
    """
    if small.rows <= max_rows:
        return big.join(F.broadcast(small.table), on, how)
    return big.join(small.table.hint("merge"), on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on keys with an explicit partition count.

    For rows that are small but expensive or about to be multiplied (a generator, a fit per group): AQE sizes
    partitions by input bytes and would gather them in a few tasks; an explicit count is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
