"""The run table (one row a model run, tags and metrics as maps), leaderboards and the champion rule."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.operators.evaluate import stored_results
from panelcast.sources.sinks import append, exists, shared_folder


def run_rows(board: DataFrame, tags: dict[str, str], started) -> DataFrame:
    """Runs from a metrics table with the column model: every other number is a metric; null ones are left out."""
    names = [c for c, t in board.dtypes if c != "model" and t in ("double", "float", "bigint", "int")]
    metrics = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("double") for c in names])), lambda _, v: v.isNotNull())
    tag_map = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]) if tags else F.create_map().cast("map<string,string>")
    return board.select("model", started.alias("started"), tag_map.alias("tags"), metrics.alias("metrics"))


def latest(runs: DataFrame) -> DataFrame:
    """The last run of each model."""
    w = Window.partitionBy("model").orderBy(F.desc("started"), F.desc(F.map_values("metrics")))
    return runs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def leaderboard(runs: DataFrame, metric: str = "wape") -> DataFrame:
    return latest(runs).select("model", F.col("metrics")[metric].alias(metric), F.col("tags")["window"].alias("window")).orderBy(F.asc_nulls_last(metric), "model")


def champion(runs: DataFrame, incumbent: str, window: str, metric: str = "wape") -> DataFrame:
    """One row: the model of the lowest metric among runs on the given window; ties keep the incumbent.

    An incumbent that was measured on another window counts as infinitely bad.
    """
    value = F.when(F.col("tags")["window"] == window, F.col("metrics")[metric])
    ranked = latest(runs).select("model", F.coalesce(value, F.lit(float("inf"))).alias(metric), (F.col("model") == incumbent).alias("__held"))
    best = ranked.orderBy(metric, F.desc("__held"), "model").limit(1)
    return best.select("model", metric, (~F.col("__held")).alias("changed"))


def run_id(*parts: Column | str) -> Column:
    """The id of a run by what tells it apart: running the same again is the same run."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\u0000")) for p in parts]), 256)


def append_runs(runs: DataFrame, path: str) -> int:
    """Append rows (run_id, model, started, tags, metrics) to the run table at path unless their run_id is there; returns how many were.

    Within runs, one row of each run_id is taken, the one of the smallest metrics
    text. One writer at a time: two at once may both find a run missing.
    """
    spark = runs.sparkSession
    text = F.to_json("metrics")
    once = runs.groupBy("run_id").agg(F.min_by(F.struct("model", "started", "tags", "metrics"), text).alias("r")).select("run_id", "r.*")
    if exists(spark, path):
        once = once.join(spark.read.parquet(path).select("run_id"), "run_id", "left_anti")
    kept = shared_folder(spark)
    once.write.parquet(kept)  # what is appended is decided once, before the table changes
    fresh = spark.read.schema(once.schema).parquet(kept)
    n = fresh.count()
    if n:
        append(fresh, path)
    return n


def log_test_results(spark: SparkSession, forecasts: str, path: str, model: str, keys: DataFrame, group: str, started: datetime, tags: dict[str, str]) -> int:
    """Log the test metrics of a model's stored forecasts as one run: overall and by group, with the band's coverage only where it has a band."""
    results = stored_results(spark, forecasts, model, keys, group).filter("value IS NOT NULL")
    metrics = results.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))  # a row a metric
    tag_map = F.create_map(*[F.lit(x) for kv in sorted(tags.items()) for x in kv]) if tags else F.create_map().cast("map<string,string>")
    at = F.lit(started).cast("timestamp_ntz")
    row = metrics.select(F.lit(model).alias("model"), at.alias("started"), tag_map.alias("tags"), "metrics")
    return append_runs(row.withColumn("run_id", run_id("model", "started", F.lit(repr(sorted(tags.items()))))), path)
