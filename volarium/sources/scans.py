"""Scans of daily panels, quote files, forecast stores and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volarium.functions.scalars import finite_or_null
from volarium.operators.panel import melt
from volarium.session import BROADCAST_ROWS, Staged, attach, stage

QUOTE_SCHEMA = "time string, bid_1 double, ask_1 double"


def wide_csv(spark: SparkSession, path: str, date_column: str = "date", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Daily wide CSV to a long panel: the first column is the date, every other column a ticker.

    Columns are read as text by their header names, so no inference pass runs over the data.
    """
    wide = spark.read.option("header", True).csv(path).withColumnRenamed(date_column, "date")
    return melt(wide.withColumn("date", F.to_date("date", date_format)))


def headerless_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", False).csv(path)


def quote_files(spark: SparkSession, path: str, schema: str = QUOTE_SCHEMA,
                ticker_pattern: str = r"([^/=]+)/[^/]*$", date_pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """All quote files below `path` in one scan; ticker and day come from each file's own path."""
    quotes = (spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
              .option("pathGlobFilter", "*.csv").csv(path))
    where = F.col("_metadata.file_path")
    return quotes.select(
        F.regexp_extract(where, ticker_pattern, 1).alias("ticker"),
        F.to_date(F.regexp_extract(where, date_pattern, 1)).alias("date"),
        *quotes.columns)


def forecasts(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    """Forecast store partitioned by run and origin; naming runs prunes the folders that are read."""
    pred = spark.read.parquet(path)
    return pred.filter(F.col("run").isin(list(runs))) if runs else pred


def run_key(name: str | Column) -> dict[str, Column]:
    """Columns of a result name like ``Forecast_Var_GHAR_iden+glasso_DJIA_W22_F1_pred.csv``."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.split(F.element_at(F.split(name, "/"), -1), "_")
    return {
        "version": F.concat_ws("_", parts.getItem(0), parts.getItem(1)),
        "model": parts.getItem(2), "adj": parts.getItem(3), "universe": parts.getItem(4),
        "window": F.regexp_extract(name, r"_W(\d+)_", 1).cast("int"),
        "horizon": F.regexp_extract(name, r"_F(\d+)", 1).cast("int"),
        "model_key": F.concat_ws("_", parts.getItem(2), parts.getItem(3)),
    }


def result_manifest(spark: SparkSession, path: str, universe: str | None = None, horizon: int | None = None, window: int | None = 22,
                    versions: Sequence[str] | None = None, models: Sequence[str] | None = None) -> Staged:
    """One row per data file of the wanted results: (path, uri, file, version, model_key, universe, window, horizon, line, header).

    Names are listed first, without opening a file, and cut down by version, model, universe, re-fit step and horizon (None takes all);
    a name may be a file or a folder of parts. Only the wanted files are then opened for their first line, which
    names the columns of this file and of no other.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path", F.col("_metadata.file_path").alias("uri"))
    keys = run_key("file")
    named = listed.withColumn("file", F.regexp_extract("path", r"([^/]+_pred\.csv)", 1)).where("file <> ''").select("path", "uri", "file", *[c.alias(n) for n, c in keys.items()])
    for column, wanted in (("version", versions), ("model_key", models), ("universe", universe and [universe]), ("horizon", horizon and [horizon]), ("window", window and [window])):
        if wanted:
            named = named.where(F.col(column).isin(list(wanted)))
    files = stage(named.drop("model", "adj"), "result-names")
    paths = [r["path"] for r in files.table.select("path").collect()]
    if not paths:
        return Staged(files.table.select("*", F.lit(None).cast("string").alias("line"), F.array().cast("array<string>").alias("header")), 0)
    lines = _text_lines(spark, paths).withColumn("at", F.monotonically_increasing_id())  # grows along a file's first block
    first = lines.where("block = 0").groupBy("uri").agg(F.min_by("value", "at").alias("line"))
    header = F.transform(F.split("line", ","), lambda c: F.btrim(c, F.lit('"')))
    return stage(files.table.join(first, "uri").withColumn("header", header), "result-manifest")


def _text_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.text(list(paths)).select("value", meta["file_path"].alias("uri"), meta["file_block_start"].alias("block"))


def read_manifest(spark: SparkSession, manifest: Staged) -> DataFrame:
    """(version, model_key, date, ticker, value) of all files of a manifest in one scan.

    Every line meets the header of its own file, so files with other columns, or the same in another order, are read
    side by side, however many headers there are. A line with fewer fields than its header has no value for the rest.
    """
    if not manifest.rows:
        return manifest.table.select("version", "model_key", F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("double").alias("value"))
    widest = manifest.table.agg(F.max(F.size("header"))).first()[0]
    schema = ", ".join(f"c{i} string" for i in range(widest))
    small = Staged(manifest.table.select("uri", "version", "model_key", "line", "header"), manifest.rows)
    paths = [r["path"] for r in manifest.table.select("path").collect()]
    lines = attach(_text_lines(spark, paths), small, ["uri"], max_rows=BROADCAST_ROWS // max(1, widest)).where("value <> line")
    parsed = lines.withColumn("fields", F.from_csv("value", schema))
    cells = parsed.select("version", "model_key", F.to_date("fields.c0").alias("date"),
                          F.posexplode(F.arrays_zip("header", F.array(*[F.col(f"fields.c{i}") for i in range(widest)]).alias("text"))).alias("at", "cell"))
    named = cells.where((F.col("at") > 0) & F.col("cell.header").isNotNull())
    return named.select("version", "model_key", "date", F.col("cell.header").alias("ticker"), finite_or_null(F.col("cell.text").try_cast("double")).alias("value"))


def result_files(spark: SparkSession, path: str, universe: str, horizon: int, window: int = 22, version: str | None = None) -> DataFrame:
    """Wide forecast CSVs named by run key, restricted to one universe, horizon and re-fit step, and to one version if named.

    Returns (model_key, date, ticker, value). Without a version the names must not mix several of them.
    """
    manifest = result_manifest(spark, path, universe, horizon, window, [version] if version else None)
    if version is None and manifest.table.select("version").distinct().count() > 1:
        raise ValueError("results of several versions lie side by side: name one")
    return read_manifest(spark, manifest).select("model_key", "date", "ticker", "value")
