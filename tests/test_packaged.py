import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelcast.operators import packaged, scoring
from panelcast.sources import ingest


INPUTS = {"key": "bigint", "hour_ts": "timestamp_ntz", "y": "int"}
OUTPUTS = {"key": "bigint", "hour_ts": "timestamp_ntz", "prediction": "double", "p10": "double", "p90": "double"}


@pytest.fixture(scope="module")
def window(spark):
    rows = spark.range(900).selectExpr("id AS key", "explode(sequence(0, 24)) AS h")
    return rows.selectExpr("key", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) AS hour_ts", "if(h = 24, null, cast((key + h) % 11 AS int)) AS y", "'more' AS extra").repartition(5).cache()


def artifact(spark, tmp_path, model=None, inputs=INPUTS, outputs=OUTPUTS):
    path = f"{tmp_path}/model.zip"
    packaged.save(model or packaged.WindowQuantiles(), path, inputs, outputs)
    return packaged.publish(spark, path)


def test_loaded_once_a_worker_and_scored_in_batches_of_whole_keys(spark, window, tmp_path, monkeypatch):
    class Counting:
        def predict(self, rows):
            out = rows[rows["y"].isna()][["key", "hour_ts"]]
            n = rows.groupby("key")["y"].size()
            assert (n == 25).all() and rows["key"].is_monotonic_increasing
            return out.assign(prediction=float(len(n)), p10=float(os.getpid()), p90=0.0)

    model = artifact(spark, tmp_path, Counting())
    loads = spark.sparkContext.accumulator(0)
    first = packaged.score_batches(window, model, n_tasks=20, loads=loads).collect()
    workers = {r.p10 for r in first}
    assert len(first) == 900 and loads.value <= len(workers) <= spark.sparkContext.defaultParallelism
    assert min(r.prediction for r in first) > 1
    before = loads.value
    packaged.score_batches(window, model, n_tasks=20, loads=loads).collect()
    assert loads.value - before <= spark.sparkContext.defaultParallelism - len(workers)


@pytest.mark.parametrize("rows", [30, 1000])
def test_batches_equal_one_key_at_a_time(spark, window, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(packaged, "BATCH_ROWS", rows)

    def one(pdf):
        y = pdf["y"].dropna()
        return pdf.iloc[-1:].assign(prediction=float(y.mean()), p10=float(y.quantile(0.1)), p90=float(y.quantile(0.9)))[["hour_ts", "prediction", "p10", "p90"]]

    by_key = {r.key: (r.prediction, r.p10, r.p90) for r in scoring.score(window, one).collect()}
    got = {r.key: (r.prediction, r.p10, r.p90) for r in packaged.score_batches(window, artifact(spark, tmp_path), n_tasks=3).collect()}
    assert got.keys() == by_key.keys() and all(got[k] == pytest.approx(by_key[k]) for k in got)


def test_changed_columns_fail_clearly(spark, window, tmp_path):
    model = artifact(spark, tmp_path)
    with pytest.raises(ValueError, match="y int .there is y string."):
        packaged.score_batches(window.withColumn("y", F.col("y").cast("string")), model)
    with pytest.raises(ValueError, match="hour_ts timestamp_ntz .there is no such column."):
        packaged.score_batches(window.drop("hour_ts"), model)
    less = artifact(spark, tmp_path, outputs=OUTPUTS | {"p50": "double"})
    with pytest.raises(Exception, match="the model gives no p50"):
        packaged.score_batches(window, less).collect()


def test_another_version_is_another_file(spark, window, tmp_path):
    old, new = artifact(spark, tmp_path), artifact(spark, tmp_path, packaged.WindowQuantiles(0.4, 0.6))
    assert old.name != new.name
    a, b = (packaged.score_batches(window.filter("key = 1"), m).first() for m in (old, new))
    assert a.p10 < b.p10 and a.prediction == b.prediction


def test_the_same_model_is_sent_once(spark, window, tmp_path):
    """On a cluster a name that is added from a second path is an error; in one process both would be listed."""
    first, again = artifact(spark, tmp_path, packaged.WindowQuantiles(0.3, 0.7)), artifact(spark, tmp_path, packaged.WindowQuantiles(0.3, 0.7))
    assert first.name == again.name and [f.rpartition("/")[2] for f in spark.sparkContext.listFiles].count(first.name) == 1
    assert packaged.score_batches(window.filter("key < 9"), again).count() == 9


def test_only_the_window_and_its_lags_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/panel"
    spark.range(3).selectExpr("id AS key", "explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-02-20', interval 1 hour)) AS hour_ts").withColumn("y", F.hour("hour_ts")).write.parquet(path)
    days = ingest.holidays(spark, 2024, 2024)
    target, rows = scoring.next_window(spark.read.parquet(path), days, 48, carried=["lag_168h"])
    assert target == datetime(2024, 2, 20, 1) and rows.count() == 3 * 49
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    first = target - timedelta(hours=48 + 169)
    assert f">= {first:%Y-%m-%d %H:%M:%S}" in plan and plan.index("Window") < plan.rindex(f">= {first:%Y-%m-%d %H:%M:%S}")


def test_workers_need_no_copy_of_the_package(tmp_path):
    """An operator runs in workers that have no path to the repository: the package reaches them as a file."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from panelcast import shipping
from panelcast.operators import packaged
def seen(batches):
    import sys
    assert not any(p.rstrip("/") == {root!r} for p in sys.path), sys.path
    import panelcast
    assert panelcast.__file__.rsplit("/", 2)[0].endswith(".zip"), panelcast.__file__
    yield from batches
shipping.ship(spark); shipping.ship(spark)
assert spark.range(10).mapInArrow(seen, "id long").count() == 10
packaged.save(packaged.WindowQuantiles(), {str(tmp_path / "m.zip")!r}, {INPUTS!r}, {OUTPUTS!r})
w = spark.range(4).selectExpr("id AS key", "explode(sequence(0, 3)) AS h").selectExpr("key", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) AS hour_ts", "if(h = 3, null, h) AS y")
print("SCORED", packaged.score_batches(w, packaged.publish(spark, {str(tmp_path / "m.zip")!r})).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SCORED 4" in done.stdout, done.stderr[-2000:]


def test_a_union_of_rows_dealt_by_key_is_scored_whole(spark, tmp_path):
    """Many rows with values and few without, dealt by key alike, so that adaptive coalescing cuts the two differently."""
    changed = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    old = {c: spark.conf.get(c, None) for c in changed}
    for c, v in changed.items():
        spark.conf.set(c, v)
    try:
        rows = spark.range(30_000).selectExpr("id AS key", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "'a' AS category")
        more = spark.range(240_000).selectExpr("id % 30000 AS key", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id div 30000 AS int)) AS hour_ts", "1 AS y")
        dealt = lambda df: df.repartition("key").groupBy("key", "hour_ts").agg(F.max("y").alias("y"))
        asked = rows.select("key", (F.col("ts") + F.expr("INTERVAL 9 HOUR")).alias("hour_ts"), F.lit(None).cast("int").alias("y"))
        out = packaged.score_batches(dealt(more).unionByName(dealt(asked)), artifact(spark, tmp_path)).collect()
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert len(out) == 30_000 and all(r.prediction is not None for r in out)
