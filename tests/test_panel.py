from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.functions import scalars
from panelcast.operators import features, observations, panel, quality
from panelcast.sources import ingest

START = datetime(2024, 1, 1)
EVENTS = "key long, ts timestamp_ntz, category string"


def hours(n):
    return START + timedelta(hours=n)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(-5, 60), st.sampled_from(["click", "view"])), max_size=40))
def test_panel_has_every_key_and_hour_and_counts_all_events_in_range(spark, rows):
    events = spark.createDataFrame([(k, hours(h) + timedelta(minutes=7), c) for k, h, c in rows], EVENTS)
    keys = spark.createDataFrame([(1,), (2,), (3,), (3,)], "key long")
    out = panel.panel(events, keys, START, hours(48), {"clicks": "click"}).collect()
    assert len(out) == 3 * 48 and len({(r.key, r.hour_ts) for r in out}) == 3 * 48
    inside = [(k, c) for k, h, c in rows if 0 <= h < 48 and k <= 3]
    assert sum(r.y for r in out) == len(inside) and sum(r.clicks for r in out) == sum(c == "click" for _, c in inside)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, hours(h), (h * (k + 2) + h // 24) % 9) for k in (1, 2) for h in range(24 * 12)]
    return spark.createDataFrame(rows, "key long, hour_ts timestamp_ntz, y int")


def test_history_sees_the_past_only(table):
    got = {(r.key, r.hour_ts): r for r in features.add_history(table).collect()}
    y = {(r.key, r.hour_ts): r.y for r in table.collect()}
    for (k, t), r in got.items():
        h = int((t - START).total_seconds() // 3600)
        for name, n in features.LAGS.items():
            assert getattr(r, name) == (y[k, t - timedelta(hours=n)] if h >= n else None)
        for name, n in features.ROLLING.items():
            past = [y[k, hours(i)] for i in range(max(0, h - n), h)]
            assert getattr(r, name) == (pytest.approx(sum(past) / len(past)) if past else None)


def test_a_change_after_the_cut_changes_no_feature_before_it(spark, table):
    cut = F.lit(hours(200)).cast("timestamp_ntz")
    shifted = table.withColumn("y", F.when(F.col("hour_ts") >= cut, F.col("y") * 100).otherwise(F.col("y")))
    none = ingest.holidays(spark, 2024, 2024)
    a, b = (features.build(t, none).filter(F.col("hour_ts") <= cut).drop("y") for t in (table, shifted))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    train = lambda t: features.key_scales(features.between(t, START, hours(200)))
    assert train(table).exceptAll(train(shifted)).isEmpty()


def test_pruned_and_whole_features_are_equal(spark, table):
    days = ingest.holidays(spark, 2024, 2024)
    lo, hi = hours(200), hours(230)
    whole = features.between(features.build(table, days), lo, hi)
    pruned = features.build(table, days, start=lo, end=hi)
    assert pruned.count() == 60 and whole.exceptAll(pruned).isEmpty() and pruned.exceptAll(whole).isEmpty()


def test_history_is_one_shuffle(table):
    plan = features.add_history(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1


def test_calendar(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 15, 5),), (datetime(2024, 1, 20, 23),)], "hour_ts timestamp_ntz")
    got = features.add_calendar(rows, ingest.holidays(spark, 2024, 2024)).orderBy("hour_ts").collect()
    assert [(r.hour, r.day_of_week, r.month, r.is_weekend, r.is_holiday) for r in got] == [(5, 0, 1, 0, 1), (23, 5, 1, 1, 0)]


def test_sparse_series_are_left_out_by_the_training_window(table, spark):
    busy = table.filter("key = 1").unionByName(spark.createDataFrame([(9, hours(300), 500)], table.schema))
    assert [r.key for r in panel.active_keys(busy, START, hours(240), 1.0).collect()] == [1]
    assert panel.restrict(busy, spark.createDataFrame([(9,)], "key long")).count() == 1


def test_standard_time_moves_to_wall_hours(spark):
    rows = [datetime(2024, 1, 10, 0, 51), datetime(2024, 7, 10, 0, 51), datetime(2024, 11, 3, 0, 51), datetime(2024, 11, 2, 23, 51), datetime(2024, 3, 10, 1, 51), datetime(2024, 1, 10, 0, 50)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t timestamp_ntz")
    got = [r.w for r in df.withColumn("w", scalars.standard_to_wall_hour("t", "America/New_York")).orderBy("k").collect()]
    assert got == [datetime(2024, 1, 10, 1), datetime(2024, 7, 10, 2), datetime(2024, 11, 3, 1), datetime(2024, 11, 3, 1), datetime(2024, 3, 10, 3), datetime(2024, 1, 10, 0)]


def test_repeated_hour_collapses(spark):
    df = spark.createDataFrame([(START, 1.0, 1.0), (START, 3.0, 5.0), (hours(1), None, 2.0)], "t timestamp_ntz, a double, b double")
    got = {r.hour_ts: (r.a, r.b) for r in observations.hourly(df, F.col("t"), ["a"], ["b"]).collect()}
    assert got == {START: (2.0, 5.0), hours(1): (None, 2.0)}


@pytest.mark.parametrize("by", [[], ["s"]])
def test_forward_fill_matches_one_long_window(spark, by):
    from pyspark.sql import Window

    rows = [(s, hours(h), float(h) if (h * 7 + s) % 5 == 0 and not 30 < h < 90 and h > 3 else None) for s in ([1, 2] if by else [1]) for h in range(150)]
    df = spark.createDataFrame(rows, "s int, hour_ts timestamp_ntz, v double")
    w = Window.partitionBy(*by).orderBy("hour_ts").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("v", F.last("v", ignorenulls=True).over(w))
    got = observations.forward_fill(df, ["v"], by)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_latest_by_is_deterministic(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1)], "k int, v string, n int")
    assert {(r.k, r.v) for r in observations.latest_by(df, ["k"], ["v", "n"]).collect()} == {(1, "a"), (2, None)}


def test_encoding_and_unknown_keys(spark, table):
    feats = features.build(table, ingest.holidays(spark, 2024, 2024)).withColumn("group_name", F.lit("North"))
    scales = features.key_scales(features.between(table, START, hours(240)))
    stats = features.column_scales(feats, ["lag_1h", "is_holiday"])
    out = features.encode(feats, scales, stats, ["lag_1h"], ["North", "South"]).collect()
    assert all(r.y_scaled == pytest.approx(r.y / r.scale) and r.group_North == 1 and r.group_South == 0 for r in out)
    assert max(abs(r.hour_sin) for r in out) <= 1
    with pytest.raises(Exception, match="no scale for key"):
        features.encode(feats, scales.filter("key = 1")).collect()
    flat = features.column_scales(feats.withColumn("c", F.lit(4.0)), ["c"]).first()
    assert (flat.c_mean, flat.c_std) == (4.0, 1.0)


def test_audits(spark, table):
    assert quality.panel_audit(table).first().gap_free
    assert not quality.panel_audit(table.filter("NOT (key = 1 AND y = 3)")).first().gap_free
    got = {r.column: r.n_null for r in quality.null_audit(features.add_history(table), ["lag_1h", "lag_168h", "y"]).collect()}
    assert got == {"lag_1h": 2, "lag_168h": 336, "y": 0}


def test_no_task_of_a_panel_grows_with_the_keys(spark, monkeypatch):
    monkeypatch.setattr(panel, "TASK_ROWS", 2_000)
    start = datetime(2024, 1, 1)
    for n_keys in (100, 400):
        ev = spark.range(n_keys).selectExpr("id AS key", "timestamp_ntz'2024-01-01 05:30:00' AS ts", "'a' AS category")
        rows = panel.panel(ev, ev, start, start + timedelta(hours=100))
        history = features.add_history(rows)
        sizes = [r["count"] for r in history.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 100 * n_keys and max(sizes) < 8_000 and len(sizes) > n_keys / 40
        assert history.filter("y = 1").count() == n_keys


def test_keys_and_counts_are_added_up_before_they_are_dealt_by_key(spark):
    """Three keys are dealt to one task: it must be given a row for each task that read them, not all events."""
    ev = spark.range(900).selectExpr("id % 3 AS key", "timestamp_ntz'2024-01-01 00:30:00' + make_dt_interval(0, cast(id % 24 AS int)) AS ts", "'a' AS category")
    rows = panel.panel(ev, ev, START, hours(24))
    lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    assert len(below) == 2 and all("HashAggregate" in line for line in below)
    assert rows.count() == 3 * 24 and rows.agg(F.sum("y")).first()[0] == 900
