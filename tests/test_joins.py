"""Joins of tables as long as the data merge: by their compressed files they look small enough to be broadcast."""

from pyspark.sql import functions as F

from panelcast.operators import evaluate, importance
from panelcast.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def forecasts(spark):
    rows = spark.range(600).selectExpr("id % 30 AS key", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id div 30 AS int)) AS hour_ts", "cast(id % 7 AS int) AS y", "3.0D AS prediction")
    return sinks.forecast_rows(rows, "m")


def merged(df):
    text = plan(df)
    return "SortMergeJoin" in text and "Broadcast" not in text


def test_permuted_inputs_are_merged(spark):
    rows = spark.range(100).select(F.col("id").alias(importance.NUMBER), (F.col("id") * 2).alias("a"))
    out = importance.permuted(rows, 100, ["a"])
    assert merged(out)
    assert sorted(r.a for r in out.collect()) == list(range(0, 200, 2))


def test_numbered_rows_stay_where_they_are(spark):
    """Where their ranges start is sent to them, and not the rows to every task."""
    rows, n = importance.numbered(spark.range(100).selectExpr("(id * 37) % 100 AS k", "id AS v"), "k")
    text = plan(rows)
    assert n == 100 and "BuildRight" in text and "BuildLeft" not in text
    sent = text[text.index("BroadcastExchange") :]
    assert "ExistingRDD" in sent and "FileScan" not in sent
    assert sorted((r.k, r[importance.NUMBER]) for r in rows.collect()) == [(i, i) for i in range(100)]


def test_stored_and_new_forecasts_are_merged(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    sinks.replace_slice(forecasts(spark), path, "model", ("key",))
    out = evaluate.reconcile_or_fail(spark.read.parquet(path), forecasts(spark))
    assert merged(out)
    assert (out.first().n, out.first().max_diff) == (600, 0.0)


def test_stored_forecasts_and_their_keys_are_merged(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    sinks.replace_slice(forecasts(spark), path, "model", ("key",))
    keys = spark.range(30).selectExpr("id AS key", "if(id < 10, 'A', 'B') AS group_name")
    out = evaluate.stored_results(spark, path, "m", keys, "group_name")
    assert merged(out)
    assert {r.metric for r in out.collect()} == {f"test_{k}{g}" for k in ("mae", "rmse", "wape") for g in ("", "_A", "_B")}
