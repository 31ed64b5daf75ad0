from datetime import datetime

from pyspark.sql import functions as F

from panelcast.operators import runs
from panelcast.sources import sinks

START = datetime(2024, 1, 1)
ROWS = "run_id string, model string, started timestamp_ntz, tags map<string,string>, metrics map<string,double>"


def test_a_run_is_appended_once(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    a = ("a", "m", START, {"window": "test"}, {"wape": 0.2})
    b = ("b", "n", START, {"window": "test"}, {"wape": 0.3})
    assert runs.append_runs(spark.createDataFrame([a, a], ROWS), path) == 1
    assert runs.append_runs(spark.createDataFrame([a, b], ROWS), path) == 1
    assert runs.append_runs(spark.createDataFrame([b, a], ROWS), path) == 0
    assert runs.append_runs(spark.createDataFrame([], ROWS), path) == 0
    stored = {r.run_id: (r.model, r.metrics) for r in spark.read.parquet(path).collect()}
    assert stored == {"a": ("m", {"wape": 0.2}), "b": ("n", {"wape": 0.3})} and spark.read.parquet(path).count() == 2


def test_ids_tell_runs_apart(spark):
    ids = [r[0] for r in spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None), ("a", "bc")], "x string, y string").select(runs.run_id("x", "y")).collect()]
    assert len(set(ids)) == 3 and ids[0] == ids[3]


def test_results_of_models_with_and_without_a_band(spark, tmp_path):
    forecasts, log = f"file://{tmp_path}/f", f"file://{tmp_path}/log"
    rows = spark.createDataFrame([("m", 1, START, 10, 12.0, 9.0, 13.0), ("m", 1, START.replace(hour=1), 10, 8.0, 9.0, 9.5)], "model string, key long, hour_ts timestamp_ntz, y int, prediction double, p10 double, p90 double")
    sinks.replace_slice(rows, forecasts, "model", ("key",))
    sinks.replace_slice(rows.withColumns({"model": F.lit("plain"), "p10": F.lit(None).cast("double")}), forecasts, "model", ("key",))
    keys = spark.createDataFrame([(1, "Old Town")], "key long, area string")
    for _ in range(2):
        done = [runs.log_test_results(spark, forecasts, log, m, keys, "area", START, {"window": "test"}) for m in ("m", "plain")]
    assert done == [0, 0]
    assert runs.log_test_results(spark, forecasts, log, "m", keys, "area", START.replace(day=2), {"window": "test"}) == 1
    stored = spark.read.parquet(log).collect()
    assert sorted(r.model for r in stored) == ["m", "m", "plain"]
    plain = next(r for r in stored if r.model == "plain")
    banded = next(r for r in stored if r.model == "m")
    assert "test_coverage_p10_p90" not in plain.metrics and banded.metrics["test_coverage_p10_p90"] == 0.5 and banded.tags == {"window": "test"}
    assert runs.leaderboard(spark.read.parquet(log), "test_wape").count() == 2
