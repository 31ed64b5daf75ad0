import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate, features, models, reports, runs, scoring
from panelcast.plans.queries import mean_of_window, trailing_quantiles
from panelcast.sources import ingest, sinks

START = datetime(2024, 1, 1)
FORECASTS = "model string, key long, hour_ts timestamp_ntz, y int, prediction double, p10 double, p90 double"


def hours(n):
    return START + timedelta(hours=n)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    rows = [(k, hours(h), int(round(20 * k * (1.5 + math.sin(2 * math.pi * h / 24)) + rng.random()))) for k in (1, 3) for h in range(24 * 24)]
    return spark.createDataFrame(rows, "key long, hour_ts timestamp_ntz, y int").repartition(3).cache()


@pytest.fixture(scope="module")
def feats(spark, series):
    return features.with_history(features.build(series, ingest.holidays(spark, 2024, 2024))).cache()


def scored(spark, rows):
    return spark.createDataFrame([("m", 1, hours(k), y, p, lo, hi) for k, (y, p, lo, hi) in enumerate(rows)], FORECASTS)


def test_metrics_by_hand(spark):
    rows = scored(spark, [(10, 12.0, 9.0, 13.0), (0, 1.0, 0.5, 2.0), (5, 2.0, 1.0, 3.0)])
    r = evaluate.metrics(rows).first()
    assert (r.mae, r.rmse, r.wape, r.n) == (2.0, pytest.approx(math.sqrt(14 / 3)), pytest.approx(6 / 15), 3)
    assert evaluate.coverage(rows).first().coverage == pytest.approx(1 / 3)
    assert evaluate.metrics(rows.withColumn("y", F.lit(0))).first().wape is None
    assert evaluate.coverage(rows.withColumn("p10", F.lit(None).cast("double"))).first().coverage is None
    assert evaluate.bias(rows).first().bias == pytest.approx(0.0)


def test_totals_and_long_names(spark):
    rows = scored(spark, [(10, 12.0, None, None), (5, 2.0, None, None)]).withColumn("area", F.when(F.col("y") == 10, "Old Town").otherwise("Port"))
    table = evaluate.metrics_with_total(rows, "area")
    assert {r.area: r.n for r in table.collect()} == {"overall": 2, "Old Town": 1, "Port": 1}
    names = {r.metric for r in evaluate.metrics_long(table, "test", "area").collect()}
    assert {"test_wape", "test_wape_Old_Town", "test_mae_Port"} <= names and len(names) == 9


def test_board_matrix_and_base(spark):
    a = scored(spark, [(10, 12.0, 9.0, 13.0), (10, 8.0, 9.0, 9.5)])
    both = a.unionByName(a.withColumn("model", F.lit("naive")).withColumn("prediction", F.lit(14.0)).withColumn("p10", F.lit(None).cast("double")))
    board = {r.model: r for r in evaluate.against(evaluate.board(both), "naive").collect()}
    assert board["naive"].coverage is None and board["m"].coverage == 0.5
    assert board["m"].vs_base == pytest.approx(-0.5)
    assert evaluate.key_matrix(both.withColumn("y", F.lit(0)), ["m", "naive"]).first()["naive"] == pytest.approx(28.0)


def test_rank_buckets_and_day_kinds(spark):
    rows = spark.createDataFrame([("m", k, hours(0), k, float(k + 1), None, None) for k in range(1, 6)], FORECASTS)
    got = {r.bucket: (r.volume, r.share) for r in evaluate.rank_buckets(rows, (1, 3)).collect()}
    assert got == {"1-1": (5, pytest.approx(5 / 15)), "2-3": (7, pytest.approx(7 / 15)), "over 3": (3, pytest.approx(3 / 15))}
    days = spark.createDataFrame([("m", 1, datetime(2024, 1, d, 3), 1, 1.0, None, None) for d in (1, 8, 9, 15, 22)], FORECASTS)
    kinds = {r.hour_ts.day: r.day_kind for r in evaluate.day_kinds(days, ingest.holidays(spark, 2024, 2024)).collect()}
    assert kinds == {1: "holiday", 8: "week_after", 9: "other", 15: "holiday", 22: "week_after"}


def test_common_rows_and_differences(spark):
    a = scored(spark, [(1, 1.0, None, None), (2, 2.0, None, None)])
    b = a.filter("y = 1").withColumn("model", F.lit("n"))
    assert evaluate.common_rows(a.unionByName(b), 2).count() == 2
    assert [(r.y, r.side) for r in evaluate.row_set_difference(a, b, ["y"]).collect()] == [(2, "left")]
    r = evaluate.reconcile(a, b.withColumn("prediction", F.lit(1.5))).first()
    assert (r.n, r.max_diff) == (1, 0.5)


def test_status_and_signed_error(spark):
    rows = scored(spark, [(10, 9.0, 8.0, 9.0), (1, 9.0, 8.0, 9.0), (8, 9.0, 8.0, 9.0), (10, 12.0, None, None), (10, 8.0, None, None), (10, 10.5, None, None), (0, 1.0, None, None)])
    got = [r.s for r in rows.select("hour_ts", reports.status().alias("s")).orderBy("hour_ts").collect()]
    assert got == ["Above", "Below", "In range", "Over-forecast", "Under-forecast", "On target", "Over-forecast"]
    e = [r.e for r in rows.select("hour_ts", reports.signed_error().alias("e")).orderBy("hour_ts").collect()]
    assert e[1] == 1.0 and e[6] == pytest.approx(0.2)


def test_nearest_hour_over_gaps_and_ends(spark):
    have = [hours(h) for h in (5, 6, 100, 190)]
    want = [hours(0), hours(5), hours(5) + timedelta(minutes=30), hours(53), hours(52), hours(145), hours(500)]
    df, wanted = spark.createDataFrame([(h,) for h in have], "hour_ts timestamp_ntz"), spark.createDataFrame([(w,) for w in want], "wanted timestamp_ntz")
    got = {r.wanted: r.hour_ts for r in reports.nearest_hour(df, wanted).collect()}
    assert got == {w: min(have, key=lambda h: (abs(h - w), h)) for w in want}


def test_week_slice_stays_inside_the_data(spark, series):
    for centre, first in (("2024-01-01 00:00:00", 0), ("2024-01-10 12:00:00", 24 * 6), ("2024-01-30 00:00:00", 24 * 17)):
        got = reports.week_around(series.filter("key = 1"), centre).agg(F.min("hour_ts"), F.count("*")).first()
        assert tuple(got) == (hours(first), 168)


def test_group_share_and_top(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1)], "group_name string, y int")
    groups = spark.createDataFrame([("a",), ("b",)], "group_name string")
    assert {r.group_name: (r.volume, r.share) for r in reports.group_share(rows, groups).collect()} == {"a": (4, 1.0), "b": (0, 0.0)}
    ranked = spark.createDataFrame([(2, 5), (1, 5), (3, 9)], "key int, v int")
    assert [r.key for r in reports.top(ranked, "v", 2).collect()] == [3, 1]


def test_naive_is_last_week(feats, series):
    y = {(r.key, r.hour_ts): r.y for r in series.collect()}
    assert all(r.prediction == y[r.key, r.hour_ts - timedelta(hours=168)] for r in models.seasonal_naive(feats).collect())


def test_poisson_fits_a_daily_pattern(feats):
    model = models.fit_poisson(features.between(feats, START, hours(24 * 20)))
    out = models.predict_poisson(model, features.between(feats, hours(24 * 20), hours(24 * 24)))
    assert evaluate.metrics(out).first().wape < 0.05 and out.agg(F.min("prediction")).first()[0] > 0


def test_rolling_backtest_in_chunks_equals_the_frame(series):
    lo, hi = hours(24 * 18), hours(24 * 24)
    frame = {(r.key, r.hour_ts): r for r in models.context_quantiles(series, lo, hi).collect()}
    for chunk in (24 * 28, 31):
        got = models.rolling_backtest(series, trailing_quantiles, lo, hi, 168, chunk).collect()
        assert len(got) == len(frame) == 2 * 24 * 6
        assert all(r.prediction == pytest.approx(frame[r.key, r.hour_ts].prediction) and r.p10 == pytest.approx(frame[r.key, r.hour_ts].p10) for r in got)


def test_short_history_is_an_error(series):
    with pytest.raises(Exception, match="hours before"):
        models.rolling_backtest(series, trailing_quantiles, hours(100), hours(120), 168).collect()
    with pytest.raises(Exception, match="too short"):
        models.contexts(series, hours(3), hours(9), 5).collect()
    rows = models.contexts(series.filter("key = 1"), hours(5), hours(7), 3).orderBy("hour_ts").collect()
    y = {r.hour_ts: r.y for r in series.filter("key = 1").collect()}
    assert [r.context for r in rows] == [[y[hours(h - 3)], y[hours(h - 2)], y[hours(h - 1)]] for h in (5, 6)]


def test_scoring_window_of_known_and_next_hour(spark, feats):
    days = ingest.holidays(spark, 2024, 2024)
    for target in (hours(24 * 20), hours(24 * 24)):
        rows = scoring.scoring_window(feats, days, target, 48, ["lag_1h"]).filter("key = 1").orderBy("hour_ts").collect()
        assert len(rows) == 49 and rows[-1].hour_ts == target and rows[-1].y is None and rows[-1].hour == target.hour
        assert all(r.y is not None for r in rows[:-1])
    assert scoring.latest_hour(feats) == hours(24 * 24 - 1)


def test_next_hour_is_scored_once_a_key(spark, feats):
    window = scoring.scoring_window(feats, ingest.holidays(spark, 2024, 2024), hours(24 * 24), 24)
    out = scoring.stamped(scoring.score(window, mean_of_window, 4), "mean", "1", START)
    assert sorted(r.key for r in out.collect()) == [1, 3]
    with pytest.raises(Exception, match="scored twice"):
        scoring.stamped(out.drop("model").unionByName(out.drop("model")), "m", "1", START).collect()


def test_slices_are_replaced_and_exported(spark, tmp_path):
    path = f"file://{tmp_path}/forecasts"
    a = sinks.forecast_rows(scored(spark, [(10, 12.04, 9.01, 13.09), (3, 1.0, 0.2, 2.2)]).drop("model"), "a")
    b = sinks.forecast_rows(a.drop("model", "p10", "p90"), "b")
    for df in (a, b, a, a):
        sinks.replace_slice(df, path, "model")
    back = spark.read.parquet(path)
    assert {(r.model, r["count"]) for r in back.groupBy("model").count().collect()} == {("a", 2), ("b", 2)}
    assert back.filter("model = 'b' AND p10 IS NULL").count() == 2
    narrow = {r.y: r for r in sinks.compact(back.filter("model = 'a'")).collect()}
    assert (round(narrow[10].p10, 1), round(narrow[10].p90, 1), round(narrow[10].prediction, 1)) == (9.1, 13.0, 12.0)
    assert sinks.delete_slice(spark, path, "model", "a") and spark.read.parquet(path).count() == 2
    sinks.export(back.filter("model = 'b'"), f"{path}-out")
    sinks.append(spark.range(2).toDF("v"), f"{path}-log")
    sinks.append(spark.range(2).toDF("v"), f"{path}-log")
    assert spark.read.parquet(f"{path}-log").count() == 4
    sinks.overwrite(spark.range(1).toDF("w"), f"{path}-log")
    assert spark.read.parquet(f"{path}-log").columns == ["w"] and sinks.exists(spark, f"{path}-out")
    assert sinks.drop_table(spark, f"{path}-log") and not sinks.exists(spark, f"{path}-log")


def test_runs_and_champion(spark):
    board = spark.createDataFrame([("naive", 0.3, None), ("other", 0.2, 0.8)], "model string, wape double, coverage double")
    old = runs.run_rows(board.withColumn("wape", F.lit(0.9)), {"window": "test"}, F.lit(START).cast("timestamp_ntz"))
    new = runs.run_rows(board, {"window": "test"}, F.lit(hours(1)).cast("timestamp_ntz"))
    table = old.unionByName(new)
    assert {r.model: r.metrics for r in runs.latest(table).collect()} == {"naive": {"wape": 0.3}, "other": {"wape": 0.2, "coverage": 0.8}}
    assert [r.model for r in runs.leaderboard(table).collect()] == ["other", "naive"]
    assert tuple(runs.champion(table, "naive", "test").first()) == ("other", 0.2, True)
    assert tuple(runs.champion(table.filter("model = 'naive'").unionByName(runs.run_rows(board.filter("model = 'other'"), {"window": "dev"}, F.lit(hours(2)).cast("timestamp_ntz"))), "other", "test").first()) == ("naive", 0.3, True)


def test_reconciliation_fails_on_a_difference_or_no_rows(spark):
    a = scored(spark, [(1, 1.0, None, None), (2, 2.0, None, None)])
    near, far = (a.withColumn("prediction", F.col("prediction") + d) for d in (0.009, 0.02))
    assert evaluate.reconcile_or_fail(a, near).first().n == 2
    with pytest.raises(Exception, match="predictions differ by"):
        evaluate.reconcile_or_fail(a, far).collect()
    with pytest.raises(Exception, match="no rows in common"):
        evaluate.reconcile_or_fail(a, a.limit(0)).collect()


def test_allowed_models_and_stored_results(spark, tmp_path):
    rows = scored(spark, [(10, 12.0, 9.0, 13.0), (10, 8.0, 9.0, 9.5)])
    assert evaluate.only_models(rows, ["m"]).count() == 2 and evaluate.only_models(rows, []).count() == 0
    path = f"file://{tmp_path}/stored"
    sinks.replace_slice(rows, path, "model", ("key",))
    sinks.replace_slice(rows.withColumn("model", F.lit("plain")).withColumn("p10", F.lit(None).cast("double")), path, "model", ("key",))
    keys = spark.createDataFrame([(1, "Old Town")], "key long, area string")
    got = {m: {r.metric: r.value for r in evaluate.stored_results(spark, path, m, keys, "area").collect()} for m in ("m", "plain")}
    assert got["m"]["test_wape_Old_Town"] == pytest.approx(0.2) and got["m"]["test_coverage_p10_p90"] == 0.5
    assert "test_coverage_p10_p90" not in got["plain"]


def test_the_hour_job_replaces_its_own_slice(spark, series, tmp_path):
    path, days = f"file://{tmp_path}/hours", ingest.holidays(spark, 2024, 2024)
    for version in ("1", "2"):
        assert scoring.score_next_hour(series, days, mean_of_window, "mean", version, path, 24, START) == hours(24 * 24)
    earlier = features.between(series, START, hours(24 * 23))
    assert scoring.score_next_hour(earlier, days, mean_of_window, "mean", "3", path, 24, START) == hours(24 * 23)
    got = sorted((r.key, r.model_version) for r in spark.read.parquet(path).collect())
    assert got == [(1, "2"), (1, "3"), (3, "2"), (3, "3")]


def test_a_key_without_the_last_hours_is_left_out_of_the_window(spark, feats):
    late = feats.filter((F.col("key") == 1) | (F.col("hour_ts") < F.lit(hours(24 * 22)).cast("timestamp_ntz")))
    window = scoring.scoring_window(late, ingest.holidays(spark, 2024, 2024), hours(24 * 24), 24)
    assert [r.key for r in window.filter("y IS NULL").collect()] == [1]


def test_poisson_takes_more_keys_than_a_solver_takes_columns(spark):
    rows = spark.range(5000).selectExpr("id AS key", "explode(sequence(169, 180)) AS h")
    rows = rows.selectExpr("key", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) AS hour_ts", "cast(key % 7 + h % 3 AS int) AS y")
    feats = features.add_calendar(rows, ingest.holidays(spark, 2024, 2024)).withColumns({c: F.col("y").cast("double") for c in features.HISTORY})
    model = models.fit_poisson(feats, max_iter=3)
    out = models.predict_poisson(model, feats.filter("key < 10").unionByName(feats.filter("key = 1").withColumn("key", F.lit(-1).cast("long"))))
    assert out.count() == 132 and out.filter("prediction <= 0 OR prediction IS NULL").isEmpty()


def test_stored_rows_have_the_shared_columns(spark):
    plain = scored(spark, [(1, 1.0, None, None)]).select("key", "hour_ts", "y", "prediction")
    out = sinks.forecast_rows(plain, "n")
    assert out.columns == list(sinks.FORECAST_COLUMNS) and out.first().p10 is None and out.first().model == "n"
