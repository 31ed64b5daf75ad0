"""One query for each operator group over the driver's tables, with the SQL that DuckDB can run beside it."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.config import LAGS, QUANTILES
from panelcast.functions import scalars
from panelcast.operators import boosting, evaluate, features, models, observations, packaged, panel, quality, reports, runs, scoring
from panelcast.sources import adapters, ingest, sinks
from panelcast.sources.adapters import CATEGORIES, EVENT_SPEC, SPLITS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Columns of results are rounded so that both engines print the same digits.
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str) -> str:
    return f"round({c}, {DIGITS}) AS {c}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# ------------------------------------------------------------------ common SQL

RAW_SQL = """
raw AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_partkey % 97 <> 0 THEN o_orderdate END AS pickup_ts,
    o_orderdate + to_minutes(CAST((l_linenumber - 1) * l_quantity AS INT)) AS dropoff_ts, CAST(l_partkey % 270 AS INT) AS zone,
    CAST(2.1 AS DOUBLE) * l_quantity - CAST(2.1 AS DOUBLE) AS distance, l_extendedprice / 100 * CASE WHEN l_partkey % 53 = 0 THEN -1 ELSE 1 END AS fare,
    l_extendedprice / 100 * CASE WHEN l_partkey % 53 = 0 THEN -1 ELSE 1 END * (1 - l_discount) AS total,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS own_month,
    CAST(CASE WHEN l_orderkey % 50 = 0 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH ELSE date_trunc('month', o_orderdate) END AS DATE) AS file_month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
timed AS (SELECT *, date_diff('second', pickup_ts, dropoff_ts) / 60.0 AS minutes FROM raw),
tagged AS (
  SELECT *, CASE WHEN pickup_ts IS NULL OR dropoff_ts IS NULL THEN 'missing_timestamp'
    WHEN pickup_ts < file_month OR pickup_ts >= file_month + INTERVAL 1 MONTH THEN 'pickup_outside_file_month'
    WHEN zone IS NULL OR zone < 1 OR zone > 263 THEN 'unknown_pickup_zone'
    WHEN minutes < 1 OR minutes > 240 THEN 'impossible_duration'
    WHEN distance IS NULL OR distance <= 0 OR distance > 100 THEN 'bad_distance'
    WHEN fare IS NULL OR fare < 0 OR fare > 1000 OR total < 0 THEN 'bad_fare' END AS drop_reason
  FROM timed)"""


def panel_sql(key: str) -> str:
    return f"""
hours AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS hour_ts),
ids AS (SELECT DISTINCT {key} AS key FROM events),
counts AS (
  SELECT {key} AS key, date_trunc('hour', ts) AS hour_ts, count(*) AS y, count(*) FILTER (WHERE event_type = 'click') AS y_click, count(*) FILTER (WHERE event_type = 'view') AS y_view
  FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2),
panel AS (
  SELECT key, hour_ts, CAST(coalesce(y, 0) AS INT) AS y, CAST(coalesce(y_click, 0) AS INT) AS y_click, CAST(coalesce(y_view, 0) AS INT) AS y_view
  FROM ids CROSS JOIN hours LEFT JOIN counts USING (key, hour_ts))"""


PANEL_A, PANEL_B = panel_sql("user_id"), panel_sql("event_type")

HOLIDAY_SQL = """
holidays AS (SELECT * FROM (VALUES (DATE '2024-01-01', 'New Year''s Day'), (DATE '2024-01-15', 'Martin Luther King Jr. Day')) t(date, holiday_name))"""

HISTORY_SQL = """
history AS (
  SELECT *, lag(y, 1) OVER w AS lag_1h, lag(y, 2) OVER w AS lag_2h, lag(y, 24) OVER w AS lag_24h, lag(y, 168) OVER w AS lag_168h,
    avg(y) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS roll_mean_24h, avg(y) OVER (w ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS roll_mean_168h
  FROM panel WINDOW w AS (PARTITION BY key ORDER BY hour_ts))"""

KEYS_SQL = """
named AS (
  SELECT DISTINCT user_id AS key, c_name AS key_name, r_name AS group_name
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

FORECAST_SQL = f"""{PANEL_A},{HISTORY_SQL},{HOLIDAY_SQL},
bands AS (
  SELECT key, hour_ts, y, quantile_cont(CAST(y AS DOUBLE), 0.1) OVER c AS p10, quantile_cont(CAST(y AS DOUBLE), 0.5) OVER c AS p50, quantile_cont(CAST(y AS DOUBLE), 0.9) OVER c AS p90
  FROM panel WINDOW c AS (PARTITION BY key ORDER BY hour_ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)),
forecasts AS (
  SELECT 'naive' AS model, key, hour_ts, y, CAST(lag_168h AS DOUBLE) AS prediction, CAST(NULL AS DOUBLE) AS p10, CAST(NULL AS DOUBLE) AS p90
  FROM history WHERE hour_ts >= TIMESTAMP '2024-01-25'
  UNION ALL SELECT 'quantile', key, hour_ts, y, p50, p10, p90 FROM bands WHERE hour_ts >= TIMESTAMP '2024-01-25')"""

NAIVE_NAMED_SQL = f"""{PANEL_A},{HISTORY_SQL},{KEYS_SQL},
scored AS (
  SELECT h.key, key_name, group_name, hour_ts, y, CAST(lag_168h AS DOUBLE) AS prediction FROM history h JOIN named USING (key)
  WHERE hour_ts >= TIMESTAMP '2024-01-25')"""

ROUNDED_METRICS = "round(avg(abs(prediction - y)), 6) AS mae, round(sqrt(avg((prediction - y) ** 2)), 6) AS rmse, CASE WHEN sum(y) <> 0 THEN round(sum(abs(prediction - y)) / sum(y), 6) END AS wape, count(*) AS n"


# ---------------------------------------------------------------- common frames


def _panel(spark: SparkSession, d: str, key: str = "user_id", categories: dict[str, str] | None = None) -> DataFrame:
    ev = adapters.events(spark, d, key)
    return panel.panel(ev, ev, SPLITS.start, SPLITS.end, categories)


def _holidays(spark: SparkSession) -> DataFrame:
    return ingest.holidays(spark, 2024, 2024)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return features.build(_panel(spark, d), _holidays(spark))


def _split(df: DataFrame, name: str) -> DataFrame:
    return features.between(df, *SPLITS.bounds(name))


def _naive(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = SPLITS.bounds("test")
    return models.seasonal_naive(features.build(_panel(spark, d), _holidays(spark), start=lo, end=hi))


def _quantile(spark: SparkSession, d: str) -> DataFrame:
    return models.context_quantiles(_panel(spark, d), *SPLITS.bounds("test"), quantiles=QUANTILES)


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.forecast_rows(_naive(spark, d), "naive").unionByName(sinks.forecast_rows(_quantile(spark, d), "quantile"))


def _naive_named(spark: SparkSession, d: str) -> DataFrame:
    """Naive test forecasts per user, with name and group."""
    lo, hi = SPLITS.bounds("test")
    history = features.add_history(_panel(spark, d), {"lag_168h": 168}, {})
    return models.seasonal_naive(features.between(history, lo, hi)).join(adapters.keys(spark, d), "key")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    raw = adapters.drifted_events(spark, d)
    lineage = {c: F.col(c) for c in ("l_orderkey", "l_linenumber", "file_month")}
    return quality.tag(ingest.normalize(raw, EVENT_SPEC, lineage), quality.event_rules())


# ------------------------------------------------------------- ingest, quality


@query(f"WITH {RAW_SQL} SELECT l_orderkey, l_linenumber, CAST(file_month AS VARCHAR) AS file_month, CAST(l_suppkey AS INT) AS vendor, pickup_ts, dropoff_ts, zone, {r('distance')}, {r('fare')}, {r('total')}, CAST(NULL AS DOUBLE) AS airport_fee FROM raw")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = adapters.drifted_events(spark, d)
    lineage = {"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber"), "file_month": F.col("file_month").cast("string")}
    return rounded(ingest.normalize(raw, EVENT_SPEC, lineage), "distance", "fare", "total")


@query("""SELECT o_orderpriority AS part, year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n_rows, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day,
  CAST(max(o_orderdate) AS DATE) = last_day(CAST(max(o_orderdate) AS DATE)) AS complete FROM orders GROUP BY 1, 2, 3""")
def file_completeness(spark: SparkSession, d: str) -> DataFrame:
    by = [F.col("o_orderpriority").alias("part"), F.year("o_orderdate").alias("year").cast("bigint").alias("year"), F.month("o_orderdate").cast("bigint").alias("month")]
    return ingest.completeness(table(spark, d, "orders"), "o_orderdate", by).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("""WITH m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) - INTERVAL 1 MONTH FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS t)
  SELECT CAST(year(t) AS INT) AS year, CAST(month(t) AS INT) AS month FROM m""")
def month_list(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = table(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")), F.max(F.date_add(F.to_date("o_orderdate"), 1))).first()
    return ingest.months(spark, lo, hi, lookback=1)


@query(f"WITH {KEYS_SQL} SELECT key, key_name, group_name FROM named WHERE key NOT IN (7, 57)")
def dimension(spark: SparkSession, d: str) -> DataFrame:
    spec = {"key": ("bigint", ("KEY",)), "key_name": ("string", ("Key_Name",)), "group_name": ("string", ("group_name",))}
    return ingest.dimension(adapters.keys(spark, d), spec, "key", drop=(7, 57))


@query(f"WITH {RAW_SQL} SELECT l_orderkey, l_linenumber, zone, drop_reason FROM tagged")
def rule_tag(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("l_orderkey", "l_linenumber", "zone", "drop_reason")


@query(f"WITH {RAW_SQL} SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM tagged GROUP BY 1")
def rule_audit(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit(_tagged(spark, d))


@query(f"WITH {RAW_SQL} SELECT l_orderkey, l_linenumber, pickup_ts, dropoff_ts, zone, {r('distance')}, {r('fare')}, round(minutes, 6) AS duration_min FROM tagged WHERE drop_reason IS NULL")
def clean(spark: SparkSession, d: str) -> DataFrame:
    out = quality.keep_valid(_tagged(spark, d)).select("l_orderkey", "l_linenumber", "pickup_ts", "dropoff_ts", "zone", "distance", "fare", "duration_min")
    return rounded(out, "distance", "fare", "duration_min")


# ---------------------------------------------------------------- observations

REPORT_SQL = """
reports AS (
  SELECT event_id, event_type AS report_type, ts AS obs_ts, CASE WHEN event_id % 17 = 0 THEN 'M' WHEN event_id % 13 = 0 THEN 'T'
    WHEN event_id % 11 = 0 THEN CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) || 's' ELSE CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) END AS amount FROM events),
parsed AS (
  SELECT *, CASE WHEN amount = 'T' THEN 0.001 ELSE TRY_CAST(regexp_extract(amount, '^-?[0-9]+([.][0-9]+)?') AS DOUBLE) END AS precip,
    TRY_CAST(regexp_extract(amount, '^-?[0-9]+([.][0-9]+)?') AS DOUBLE) AS temp FROM reports),
hourly AS (
  SELECT date_trunc('hour', obs_ts) AS hour_ts, avg(temp) AS temp, max(precip) AS precip FROM parsed WHERE report_type = 'click' GROUP BY 1)"""


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    parsed = adapters.reports(spark, d).withColumns({"precip": scalars.measure("amount", 0.001), "temp": scalars.measure("level")})
    return observations.hourly(parsed.filter(F.trim("report_type") == "click"), scalars.hour_of("obs_ts"), ["temp"], ["precip"])


@query(f"WITH {REPORT_SQL} SELECT event_id, precip, temp FROM parsed")
def parse_numbers(spark: SparkSession, d: str) -> DataFrame:
    return adapters.reports(spark, d).select("event_id", scalars.measure("amount", 0.001).alias("precip"), scalars.measure("level").alias("temp"))


@query(f"WITH {REPORT_SQL} SELECT hour_ts, {r('temp')}, {r('precip')} FROM hourly")
def hourly_obs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_hourly(spark, d), "temp", "precip")


@query("""WITH t AS (SELECT o_totalprice, o_orderdate + to_hours(CAST(o_orderkey % 24 + k AS INT)) + INTERVAL 51 MINUTE AS obs FROM orders, (VALUES (0), (1)) v(k)),
  w AS (SELECT o_totalprice, (date_trunc('hour', obs + INTERVAL 9 MINUTE) + INTERVAL 5 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS hour_ts FROM t)
  SELECT hour_ts, round(avg(o_totalprice), 4) AS level, max(o_totalprice) AS most FROM w GROUP BY 1""")
def dst_collapse(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.standard_time_reports(spark, d).withColumns({"level": F.col("o_totalprice"), "most": F.col("o_totalprice")})
    out = observations.hourly(rows, scalars.standard_to_wall_hour("obs_ts", "America/New_York"), ["level"], ["most"])
    return out.withColumn("level", F.round("level", 4))


@query(f"""WITH {REPORT_SQL}, {PANEL_A}, joined AS (SELECT hours.hour_ts, temp, precip FROM hours LEFT JOIN hourly USING (hour_ts)),
  filled AS (SELECT hour_ts, last_value(temp IGNORE NULLS) OVER w AS temp, last_value(precip IGNORE NULLS) OVER w AS precip FROM joined WINDOW w AS (ORDER BY hour_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT hour_ts, {r('temp')}, {r('precip')}, CAST(precip > 0 AS DOUBLE) AS is_raining FROM filled""")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    out = observations.fill_gaps(_hourly(spark, d), _spine(spark, d), ["temp", "precip"], "precip")
    return rounded(out, "temp", "precip").withColumn("is_raining", F.col("is_raining").cast("double"))


def _spine(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").agg(F.min(scalars.hour_of("ts")).alias("lo"), F.max(scalars.hour_of("ts")).alias("hi"))
    return observations.hour_spine(days, F.col("lo"), F.col("hi") + F.expr("INTERVAL 1 HOUR")).select("hour_ts")


@query("SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS hour_ts")
def hour_spine(spark: SparkSession, d: str) -> DataFrame:
    return _spine(spark, d)


# ------------------------------------------------------------- panel, features


@query(f"WITH {PANEL_A} SELECT key, hour_ts, y FROM panel")
def panel_counts(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d)


@query(f"WITH {PANEL_B} SELECT key, hour_ts, y, y_click, y_view FROM panel")
def panel_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d, "event_type", CATEGORIES)


@query(f"WITH {PANEL_A} SELECT count(*) AS n_rows, count(DISTINCT key) AS n_keys, count(DISTINCT hour_ts) AS n_hours, count(*) = count(DISTINCT key) * count(DISTINCT hour_ts) AS gap_free FROM panel")
def panel_audit(spark: SparkSession, d: str) -> DataFrame:
    return quality.panel_audit(_panel(spark, d))


@query(f"WITH {PANEL_A} SELECT key, round(sum(y) / 19.0, 6) AS avg_daily FROM panel WHERE hour_ts < TIMESTAMP '2024-01-20' GROUP BY 1 HAVING sum(y) / 19.0 >= 2.0")
def active_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.active_keys(_panel(spark, d), *SPLITS.bounds("train"), min_daily=2.0), "avg_daily")


@query(f"""WITH {PANEL_A}, {HOLIDAY_SQL} SELECT DISTINCT hour_ts, CAST(hour(hour_ts) AS INT) AS hour, CAST(isodow(hour_ts) - 1 AS INT) AS day_of_week, CAST(month(hour_ts) AS INT) AS month,
  CAST(isodow(hour_ts) >= 6 AS INT) AS is_weekend, CAST(CAST(hour_ts AS DATE) IN (SELECT date FROM holidays) AS INT) AS is_holiday FROM panel""")
def calendar(spark: SparkSession, d: str) -> DataFrame:
    return features.add_calendar(_spine(spark, d), _holidays(spark))


@query(f"WITH {PANEL_A},{HISTORY_SQL} SELECT key, hour_ts, y, CAST(lag_1h AS DOUBLE) AS lag_1h, CAST(lag_2h AS DOUBLE) AS lag_2h, CAST(lag_24h AS DOUBLE) AS lag_24h, CAST(lag_168h AS DOUBLE) AS lag_168h FROM history")
def lags(spark: SparkSession, d: str) -> DataFrame:
    return features.add_history(_panel(spark, d), rolling={}).withColumns({c: F.col(c).cast("double") for c in LAGS})


@query(f"WITH {PANEL_A},{HISTORY_SQL} SELECT key, hour_ts, y, {r('roll_mean_24h')}, {r('roll_mean_168h')} FROM history")
def rolling_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.add_history(_panel(spark, d), lags={}), "roll_mean_24h", "roll_mean_168h")


FEATURES_SQL = f"""{REPORT_SQL}, {PANEL_A},{HISTORY_SQL},{KEYS_SQL},{HOLIDAY_SQL},
feats AS (
  SELECT h.key, h.hour_ts, y, lag_1h, lag_2h, lag_24h, lag_168h, {r('roll_mean_24h')}, {r('roll_mean_168h')}, CAST(hour(h.hour_ts) AS INT) AS hour, CAST(isodow(h.hour_ts) - 1 AS INT) AS day_of_week,
    CAST(month(h.hour_ts) AS INT) AS month, CAST(isodow(h.hour_ts) >= 6 AS INT) AS is_weekend, CAST(CAST(h.hour_ts AS DATE) IN (SELECT date FROM holidays) AS INT) AS is_holiday,
    {r('temp')}, {r('precip')}, key_name, group_name
  FROM history h LEFT JOIN hourly o ON o.hour_ts = h.hour_ts LEFT JOIN named n ON n.key = h.key)"""


@query(f"WITH {FEATURES_SQL} SELECT * FROM feats WHERE lag_168h IS NOT NULL")
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    out = features.build(_panel(spark, d), _holidays(spark), _hourly(spark, d), adapters.keys(spark, d))
    return rounded(features.with_history(out), "roll_mean_24h", "roll_mean_168h", "temp", "precip")


@query(f"WITH {FEATURES_SQL} SELECT * FROM feats WHERE hour_ts >= TIMESTAMP '2024-01-25'")
def pruned_features(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = SPLITS.bounds("test")
    out = features.build(_panel(spark, d), _holidays(spark), _hourly(spark, d), adapters.keys(spark, d), lo, hi)
    return rounded(out, "roll_mean_24h", "roll_mean_168h", "temp", "precip")


@query(f"""WITH {PANEL_A} SELECT CASE WHEN hour_ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN hour_ts < TIMESTAMP '2024-01-25' THEN 'validation' ELSE 'test' END AS split,
  count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS total, min(hour_ts) AS first_hour, max(hour_ts) AS last_hour FROM panel GROUP BY 1""")
def splits(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    parts = [_split(p, name).withColumn("split", F.lit(name)) for name in ("train", "validation", "test")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("y").alias("total"), F.min("hour_ts").alias("first_hour"), F.max("hour_ts").alias("last_hour"))


@query(
    f"WITH {PANEL_A},{HISTORY_SQL} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, count(*) AS n_rows FROM history" for c in features.HISTORY)
)
def null_audit(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_audit(features.add_history(_panel(spark, d)), features.HISTORY)


@query(f"WITH {PANEL_A} SELECT key, round(greatest(avg(y), 0.1), 6) AS scale FROM panel WHERE hour_ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def train_scales(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.key_scales(_split(_panel(spark, d), "train")), "scale")


ENCODED_SQL = f"""{REPORT_SQL}, {PANEL_A}, {KEYS_SQL}, scales AS (SELECT key, greatest(avg(y), 0.1) AS scale FROM panel WHERE hour_ts < TIMESTAMP '2024-01-20' GROUP BY 1),
  obs AS (SELECT avg(temp) AS m, CASE WHEN coalesce(stddev_samp(temp), 0) = 0 THEN 1 ELSE stddev_samp(temp) END AS s FROM panel LEFT JOIN hourly USING (hour_ts) WHERE hour_ts < TIMESTAMP '2024-01-20')"""


@query(f"""WITH {ENCODED_SQL} SELECT key, hour_ts, y, round(y / scale, 6) AS y_scaled, round(sin(2 * pi() * hour(hour_ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * (isodow(hour_ts) - 1) / 7), 6) AS dow_cos,
  CAST((isodow(hour_ts) - 1) * 24 + hour(hour_ts) AS INT) AS hour_of_week, round((temp - m) / s, 6) AS temp_z, CAST(group_name = 'ASIA' AS DOUBLE) AS "group_ASIA" FROM panel JOIN scales USING (key) LEFT JOIN named USING (key) LEFT JOIN hourly USING (hour_ts), obs""")
def encoded_features(spark: SparkSession, d: str) -> DataFrame:
    feats = features.build(_panel(spark, d), _holidays(spark), _hourly(spark, d), adapters.keys(spark, d))
    train = _split(feats, "train")
    out = features.encode(feats, features.key_scales(train), features.column_scales(train, ["temp"]), ["temp"], ["ASIA"])
    return rounded(out, "y_scaled", "hour_sin", "dow_cos", "temp_z").select("key", "hour_ts", "y", "y_scaled", "hour_sin", "dow_cos", "hour_of_week", "temp_z", "group_ASIA")


# -------------------------------------------------------------------- forecasts


@query(f"WITH {FORECAST_SQL} SELECT key, hour_ts, y, prediction FROM forecasts WHERE model = 'naive'")
def naive_forecast(spark: SparkSession, d: str) -> DataFrame:
    return _naive(spark, d).select("key", "hour_ts", "y", "prediction")


@query(f"WITH {FORECAST_SQL} SELECT key, {ROUNDED_METRICS} FROM forecasts WHERE model = 'naive' GROUP BY key")
def naive_metrics_by_key(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics(_naive(spark, d), "key"), "mae", "rmse", "wape")


@query(f"WITH {FORECAST_SQL} SELECT key, hour_ts, y, {r('p10')}, {r('prediction')}, {r('p90')} FROM forecasts WHERE model = 'quantile'")
def grouped_quantile_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_quantile(spark, d), "p10", "prediction", "p90")


def trailing_quantiles(pdf):
    """The pluggable forecaster's stand-in: empirical quantiles of the 168 rows before each."""
    past = pdf["y"].shift(1).rolling(168, min_periods=1)
    return pdf.assign(prediction=past.quantile(0.5), p10=past.quantile(0.1), p90=past.quantile(0.9))


@query(f"WITH {FORECAST_SQL} SELECT key, hour_ts, y, {r('p10')}, {r('prediction')}, {r('p90')} FROM forecasts WHERE model = 'quantile'")
def pluggable_backtest(spark: SparkSession, d: str) -> DataFrame:
    out = models.rolling_backtest(_panel(spark, d), trailing_quantiles, *SPLITS.bounds("test"), context=168)
    return rounded(out, "p10", "prediction", "p90")


@query(f"WITH {PANEL_A}, c AS (SELECT key, hour_ts, y, list(y) OVER (PARTITION BY key ORDER BY hour_ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS c FROM panel) SELECT key, hour_ts, y, CAST(list_sum(c) AS BIGINT) AS total, c[1] AS oldest, c[24] AS newest FROM c WHERE hour_ts >= TIMESTAMP '2024-01-25'")
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    out = models.contexts(_panel(spark, d), *SPLITS.bounds("test"), context=24)
    return out.select("key", "hour_ts", "y", F.aggregate("context", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.get("context", 0).alias("oldest"), F.get("context", 23).alias("newest"))


def _written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: it is used several times, and an executor may be lost."""
    path = sinks.shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _glm_scored(spark: SparkSession, d: str) -> DataFrame:
    observed = observations.fill_gaps(_hourly(spark, d), _spine(spark, d), ["temp", "precip"], "precip")
    feats = _written(features.with_history(features.build(_panel(spark, d), _holidays(spark), observed)))
    return models.predict_poisson(models.fit_poisson(_split(feats, "train"), ("temp", "is_raining")), _split(feats, "test"))


@query()
def poisson_glm(spark: SparkSession, d: str) -> DataFrame:
    return _glm_scored(spark, d).select("key", "hour_ts", "y", "prediction")


@query(f"WITH {PANEL_A} SELECT count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS total, true AS all_positive, true AS total_within_a_quarter, true AS better_than_last_week FROM panel WHERE hour_ts >= TIMESTAMP '2024-01-25'")
def poisson_glm_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the GLM's test forecasts: every row is there, none is below zero, the total is about right, and squared errors are smaller than last week's."""
    both = _glm_scored(spark, d)
    square = lambda c: F.sum((F.col(c) - F.col("y")) ** 2)
    return both.agg(
        F.count("*").alias("n_rows"),
        F.sum("y").alias("total"),
        (F.min("prediction") > 0).alias("all_positive"),
        (F.abs(F.sum("prediction") - F.sum("y")) < 0.25 * F.sum("y")).alias("total_within_a_quarter"),
        (square("prediction") < square("lag_168h")).alias("better_than_last_week"),
    )


GLM_TRAIN_SQL = f"""{PANEL_A},{HISTORY_SQL},{HOLIDAY_SQL}, train AS (
  SELECT *, CAST(CAST(hour_ts AS DATE) IN (SELECT date FROM holidays) AS INT) AS is_holiday FROM history WHERE lag_168h IS NOT NULL AND hour_ts < TIMESTAMP '2024-01-20')"""


def _glm_train(spark: SparkSession, d: str) -> DataFrame:
    feats = _split(_written(features.with_history(_features(spark, d))), "train")
    return models.predict_poisson(models.fit_poisson(feats), feats)


@query(f"WITH {GLM_TRAIN_SQL} SELECT key, CAST(sum(y) AS BIGINT) AS total, round(CAST(sum(y) AS DOUBLE), 5) AS predicted FROM train GROUP BY 1")
def poisson_key_totals(spark: SparkSession, d: str) -> DataFrame:
    """On the training rows the joint fit's forecasts of each key add up to what was counted."""
    return _glm_train(spark, d).groupBy("key").agg(F.sum("y").alias("total"), F.round(F.sum("prediction"), 5).alias("predicted"))


@query(
    f"WITH {GLM_TRAIN_SQL}, sums AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS input, sum(y * ln(1 + CAST({c} AS DOUBLE))) AS s FROM train" for c in features.HISTORY)
    + " UNION ALL SELECT 'is_holiday', sum(CAST(y * is_holiday AS DOUBLE)) FROM train"
    + " UNION ALL SELECT 'hour_of_week ' || ((isodow(hour_ts) - 1) * 24 + hour(hour_ts)), CAST(sum(y) AS DOUBLE) FROM train GROUP BY 1) SELECT input, round(s, 3) AS counted, round(s, 3) AS predicted FROM sums"
)
def poisson_score_equations(spark: SparkSession, d: str) -> DataFrame:
    """At the maximum of the likelihood the sums of each input over counts and over forecasts are the same, and so are those of each hour of the week."""
    scored = _written(_glm_train(spark, d))
    both = lambda x: (F.round(F.sum(F.col("y") * x), 3).alias("counted"), F.round(F.sum(F.col("prediction") * x), 3).alias("predicted"))
    parts = [scored.agg(*both(F.log1p(F.col(c).cast("double")))).select(F.lit(c).alias("input"), "counted", "predicted") for c in features.HISTORY]
    parts.append(scored.agg(*both(F.col("is_holiday").cast("double"))).select(F.lit("is_holiday").alias("input"), "counted", "predicted"))
    parts.append(scored.groupBy(F.concat(F.lit("hour_of_week "), scalars.hour_of_week().cast("string")).alias("input")).agg(*both(F.lit(1.0))))
    return reduce(DataFrame.unionByName, parts)


def _boosted(spark: SparkSession, d: str):
    """Features, scales of the training rows, and the boosted model with bands calibrated on validation rows."""
    feats = _written(features.with_history(_features(spark, d)))
    scales = _written(features.key_scales(_split(feats, "train")))
    return feats, scales, boosting.calibrate(boosting.fit_quantiles(_split(feats, "train"), scales), _split(feats, "validation"), scales)


def _boosted_scored(spark: SparkSession, d: str) -> DataFrame:
    feats, scales, model = _boosted(spark, d)
    return boosting.predict_quantiles(model, boosting.boost_inputs(_split(feats, "test"), scales))


@query()
def global_quantile(spark: SparkSession, d: str) -> DataFrame:
    return _boosted_scored(spark, d)


@query(f"WITH {PANEL_A} SELECT count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS total, true AS ordered, true AS not_negative, true AS band_covers FROM panel WHERE hour_ts >= TIMESTAMP '2024-01-25'")
def global_quantile_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the boosted model's bands: every row is there, quantiles are in order and not below zero, and the band covers most rows."""
    return _boosted_scored(spark, d).agg(
        F.count("*").alias("n_rows"),
        F.sum("y").alias("total"),
        F.bool_and((F.col("p10") <= F.col("prediction")) & (F.col("prediction") <= F.col("p90"))).alias("ordered"),
        (F.min("p10") >= 0).alias("not_negative"),
        (F.avg(evaluate.inside_band().cast("double")) >= 0.6).alias("band_covers"),
    )


@query(f"WITH {PANEL_A} SELECT q.quantile, count(*) AS n_rows, CAST(0 AS DOUBLE) AS max_diff FROM panel, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) q(quantile) WHERE hour_ts >= TIMESTAMP '2024-01-25' GROUP BY 1")
def quantile_trees(spark: SparkSession, d: str) -> DataFrame:
    """The boosted model exported as a table of nodes, and its test forecasts computed by joins with that table, held against the model's own."""
    feats, scales, model = _boosted(spark, d)
    path = sinks.shared_folder(spark)
    sinks.overwrite(boosting.trees_table(spark, model), path)
    rows = boosting.boost_inputs(_split(feats, "test"), scales)
    own = rows.select("key", "hour_ts", F.posexplode(boosting.raw_quantiles(model)).alias("k", "own")).withColumn("quantile", F.element_at(F.array(*[F.lit(q) for q in model.quantiles]), F.col("k") + 1))
    both = boosting.scored_by_table(spark.read.parquet(path), rows, 4).join(own, ["key", "hour_ts", "quantile"])
    return both.groupBy("quantile").agg(F.count("*").alias("n_rows"), F.round(F.max(F.abs(F.col("raw") - F.col("own"))), DIGITS).alias("max_diff"))


@query()
def importance(spark: SparkSession, d: str) -> DataFrame:
    rows = boosting.gains(_boosted(spark, d)[2])
    return spark.createDataFrame(rows, "group string, input string, importance double")


# ------------------------------------------------------------------- evaluation



@query(f"WITH {NAIVE_NAMED_SQL} SELECT coalesce(group_name, 'overall') AS group_name, {ROUNDED_METRICS} FROM scored GROUP BY GROUPING SETS ((), (group_name))")
def metrics_overall_and_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics_with_total(_naive_named(spark, d), "group_name"), "mae", "rmse", "wape")


@query(f"""WITH {NAIVE_NAMED_SQL}, m AS (SELECT CASE WHEN group_name IS NULL THEN '' ELSE '_' || replace(group_name, ' ', '_') END AS g, {ROUNDED_METRICS} FROM scored GROUP BY GROUPING SETS ((), (group_name)))
  SELECT 'test_mae' || g AS metric, mae AS value FROM m UNION ALL SELECT 'test_rmse' || g, rmse FROM m UNION ALL SELECT 'test_wape' || g, wape FROM m""")
def metrics_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics_long(evaluate.metrics_with_total(_naive_named(spark, d), "group_name"), "test", "group_name"), "value")


@query(f"WITH {FORECAST_SQL} SELECT model, key, round(avg(CAST(y >= p10 AND y <= p90 AS DOUBLE)), 6) AS coverage FROM forecasts GROUP BY 1, 2")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.coverage(_forecasts(spark, d), "model", "key"), "coverage")


BOARD_SQL = f"""{FORECAST_SQL}, board AS (
  SELECT model, sum(abs(prediction - y)) / sum(y) AS wape, avg(abs(prediction - y)) AS mae, avg(CAST(y >= p10 AND y <= p90 AS DOUBLE)) AS coverage FROM forecasts GROUP BY 1)"""


@query(f"WITH {BOARD_SQL} SELECT model, {r('wape')}, {r('mae')}, {r('coverage')} FROM board")
def model_board(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.board(_forecasts(spark, d)), "wape", "mae", "coverage")


@query(f"WITH {BOARD_SQL} SELECT model, {r('wape')}, round(wape / (SELECT wape FROM board WHERE model = 'naive') - 1, 6) AS vs_base FROM board")
def vs_naive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.against(evaluate.board(_forecasts(spark, d)), "naive"), "wape", "vs_base").select("model", "wape", "vs_base")


@query(f"""WITH {FORECAST_SQL}, k AS (SELECT key, model, round(sum(abs(prediction - y)) / greatest(sum(y), 1), 6) AS w FROM forecasts GROUP BY 1, 2)
  SELECT key, max(w) FILTER (WHERE model = 'naive') AS naive, max(w) FILTER (WHERE model = 'quantile') AS quantile FROM k GROUP BY 1""")
def key_model_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.key_matrix(_forecasts(spark, d), ["naive", "quantile"]), "naive", "quantile")


@query(f"WITH {FORECAST_SQL} SELECT model, CAST(hour(hour_ts) AS INT) AS hour, round(sum(abs(prediction - y)) / nullif(sum(y), 0), 6) AS wape, count(*) AS n FROM forecasts GROUP BY 1, 2")
def error_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.by_hour(_forecasts(spark, d)), "wape")


@query(f"""WITH {PANEL_A},{HISTORY_SQL},{HOLIDAY_SQL}, s AS (SELECT key, hour_ts, y, CAST(lag_168h AS DOUBLE) AS prediction,
    CASE WHEN CAST(hour_ts AS DATE) IN (SELECT date FROM holidays) THEN 'holiday' WHEN CAST(hour_ts AS DATE) - 7 IN (SELECT date FROM holidays) THEN 'week_after' ELSE 'other' END AS day_kind
    FROM history WHERE lag_168h IS NOT NULL) SELECT day_kind, round(sum(abs(prediction - y)) / nullif(sum(y), 0), 6) AS wape, count(*) AS n FROM s GROUP BY 1""")
def holiday_effect(spark: SparkSession, d: str) -> DataFrame:
    scored = models.seasonal_naive(features.with_history(_features(spark, d)))
    return rounded(evaluate.metrics(evaluate.day_kinds(scored, _holidays(spark)), "day_kind").select("day_kind", "wape", "n"), "wape")


@query(f"""WITH {NAIVE_NAMED_SQL}, v AS (SELECT key, sum(y) AS volume FROM scored GROUP BY 1), k AS (SELECT key, row_number() OVER (ORDER BY volume DESC, key) AS rank FROM v),
  b AS (SELECT *, CASE WHEN rank <= 20 THEN '1-20' WHEN rank <= 60 THEN '21-60' WHEN rank <= 120 THEN '61-120' ELSE 'over 120' END AS bucket FROM scored JOIN k USING (key))
  SELECT 'naive' AS model, bucket, round(sum(abs(prediction - y)) / nullif(sum(y), 0), 6) AS wape, CAST(sum(y) AS BIGINT) AS volume, round(sum(y) / (SELECT sum(y) FROM scored), 6) AS share FROM b GROUP BY 2""")
def rank_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.rank_buckets(_naive_named(spark, d).withColumn("model", F.lit("naive")), (20, 60, 120)), "wape", "share")


@query(f"WITH {FORECAST_SQL} SELECT model, round(sum(prediction) / sum(y) - 1, 6) AS bias FROM forecasts GROUP BY 1")
def bias(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.bias(_forecasts(spark, d), "model"), "bias")


@query(f"WITH {FORECAST_SQL} SELECT model, hour_ts, round((sum(prediction) - sum(y)) / nullif(sum(y), 0), 6) AS total_error FROM forecasts GROUP BY 1, 2")
def total_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.total_error(_forecasts(spark, d), "model", "hour_ts"), "total_error")


@query(f"WITH {FORECAST_SQL}, c AS (SELECT * FROM forecasts WHERE NOT (model = 'naive' AND hour(hour_ts) < 3)) SELECT model, key, hour_ts, y FROM c WHERE hour(hour_ts) >= 3")
def common_rows(spark: SparkSession, d: str) -> DataFrame:
    some = _forecasts(spark, d).filter((F.col("model") != "naive") | (F.hour("hour_ts") >= 3))
    return evaluate.common_rows(some, 2).select("model", "key", "hour_ts", "y")


@query(f"WITH {FORECAST_SQL} SELECT key, hour_ts, 'right' AS side FROM forecasts WHERE model = 'naive' AND hour(hour_ts) < 3")
def row_set_difference(spark: SparkSession, d: str) -> DataFrame:
    f = _forecasts(spark, d)
    return evaluate.row_set_difference(f.filter((F.col("model") == "naive") & (F.hour("hour_ts") >= 3)), f.filter("model = 'quantile'"), ["key", "hour_ts"])


@query(f"WITH {FORECAST_SQL} SELECT count(*) AS n, round(max(abs(a.prediction - b.prediction)), 6) AS max_diff FROM forecasts a JOIN forecasts b USING (key, hour_ts) WHERE a.model = 'naive' AND b.model = 'quantile'")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    f = _forecasts(spark, d)
    return rounded(evaluate.reconcile(f.filter("model = 'naive'"), f.filter("model = 'quantile'")), "max_diff")


# ---------------------------------------------------------------------- reports


@query(f"WITH {NAIVE_NAMED_SQL}, v AS (SELECT group_name, sum(y) AS volume FROM scored WHERE y > 0 GROUP BY 1), g AS (SELECT r_name AS group_name, CAST(coalesce(volume, 0) AS BIGINT) AS volume FROM region LEFT JOIN v ON r_name = group_name) SELECT group_name, volume, round(volume / sum(volume) OVER (), 6) AS share FROM g")
def group_share(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "region").select(F.col("r_name").alias("group_name"))
    return rounded(reports.group_share(_naive_named(spark, d).filter("y > 0"), groups), "share")


@query(f"WITH {NAIVE_NAMED_SQL}, v AS (SELECT key, key_name, group_name, CAST(sum(y) AS BIGINT) AS total FROM scored GROUP BY 1, 2, 3) SELECT * FROM v ORDER BY total DESC, key LIMIT 15")
def busiest(spark: SparkSession, d: str) -> DataFrame:
    return reports.top(_naive_named(spark, d).groupBy("key", "key_name", "group_name").agg(F.sum("y").alias("total")), "total", 15)


@query(f"""WITH {FORECAST_SQL} SELECT model, key, hour_ts, CASE WHEN p10 IS NOT NULL THEN CASE WHEN y > p90 THEN 'Above' WHEN y < p10 THEN 'Below' ELSE 'In range' END
  WHEN (prediction - y) / greatest(y, 1) > 0.15 THEN 'Over-forecast' WHEN (prediction - y) / greatest(y, 1) < -0.15 THEN 'Under-forecast' ELSE 'On target' END AS status,
  round(greatest(least((prediction - y) / greatest(y, 5.0), 1), -1), 6) AS signed_error FROM forecasts""")
def interval_status(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_forecasts(spark, d).select("model", "key", "hour_ts", reports.status().alias("status"), reports.signed_error().alias("signed_error")), "signed_error")


@query(f"""WITH {REPORT_SQL}, w AS (SELECT DISTINCT date_trunc('minute', ts) AS wanted FROM events WHERE event_type = 'view')
  SELECT wanted, arg_min(hour_ts, (abs(epoch_us(hour_ts) - epoch_us(wanted)), hour_ts)) AS hour_ts FROM w, hourly WHERE hour_ts BETWEEN wanted - INTERVAL 3 DAY AND wanted + INTERVAL 3 DAY GROUP BY 1""")
def nearest_hour(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "events").filter("event_type = 'view'").select(F.expr("ts - make_dt_interval(0, 0, 0, extract(SECOND FROM ts))").alias("wanted")).distinct()
    return reports.nearest_hour(_hourly(spark, d).select("hour_ts"), wanted)


@query(f"WITH {PANEL_A} SELECT key, hour_ts, y FROM panel WHERE hour_ts >= TIMESTAMP '2024-01-24' AND hour_ts < TIMESTAMP '2024-01-31'")
def week_slice(spark: SparkSession, d: str) -> DataFrame:
    return reports.week_around(_panel(spark, d), "2024-01-29 12:00:00")


@query(f"WITH {FORECAST_SQL} SELECT model, key, hour_ts, y, round(round(prediction * 10) / 10, 1) AS prediction, round(ceil(p10 * 10) / 10, 1) AS p10, round(floor(p90 * 10) / 10, 1) AS p90 FROM forecasts")
def export_projection(spark: SparkSession, d: str) -> DataFrame:
    # floats widen with noise in their last digits; the export itself keeps them narrow
    return sinks.compact(_forecasts(spark, d)).withColumns({c: F.round(F.col(c).cast("double"), 1) for c in ("prediction", "p10", "p90")} | {"y": F.col("y").cast("int")})


@query(f"WITH {FORECAST_SQL} SELECT model, count(*) AS n, round(sum(prediction), 4) AS total FROM forecasts GROUP BY 1")
def replace_slice(spark: SparkSession, d: str) -> DataFrame:
    path, f = sinks.shared_folder(spark), _forecasts(spark, d)
    sinks.replace_slice(f.withColumn("prediction", F.lit(0.0)), path, "model", ("key",))
    for m in ("naive", "quantile", "naive"):
        sinks.replace_slice(f.filter(F.col("model") == m), path, "model", ("key",))
    return spark.read.parquet(path).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 4).alias("total"))


# ------------------------------------------------------------------ runs, scoring


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A run a model and test day: the last day's counts as the latest."""
    f = _forecasts(spark, d)
    daily = f.groupBy("model", F.to_date("hour_ts").alias("day")).agg(*evaluate.metric_columns(), F.avg(evaluate.inside_band().cast("double")).alias("coverage"))
    parts = runs.run_rows(daily.withColumnRenamed("day", "window_day"), {"window": "test"}, F.col("window_day").cast("timestamp_ntz"))
    return parts


RUNS_SQL = f"""{FORECAST_SQL}, runs AS (SELECT model, CAST(hour_ts AS DATE) AS started, sum(abs(prediction - y)) / nullif(sum(y), 0) AS wape FROM forecasts GROUP BY 1, 2),
  latest AS (SELECT model, round(wape, 6) AS wape, CAST(started AS TIMESTAMP) AS started FROM runs QUALIFY row_number() OVER (PARTITION BY model ORDER BY started DESC) = 1)"""


@query(f"WITH {RUNS_SQL} SELECT model, started, wape FROM latest")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.latest(_runs(spark, d)).select("model", "started", F.round(F.col("metrics")["wape"], DIGITS).alias("wape"))


@query(f"WITH {RUNS_SQL} SELECT model, wape, 'test' AS \"window\" FROM latest")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runs.leaderboard(_runs(spark, d)), "wape")


@query(f"WITH {RUNS_SQL} SELECT model, wape, model <> 'naive' AS changed FROM latest ORDER BY wape, model <> 'naive' LIMIT 1")
def champion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runs.champion(_runs(spark, d), "naive", "test"), "wape")


WINDOW_SQL = f"""{PANEL_A},{HOLIDAY_SQL}, win AS (
  SELECT key, hour_ts, y FROM panel WHERE hour_ts >= TIMESTAMP '2024-01-29' UNION ALL SELECT DISTINCT key, TIMESTAMP '2024-01-31', NULL FROM panel)"""


@query(f"""WITH {WINDOW_SQL} SELECT key, hour_ts, CAST(y AS DOUBLE) AS y, CAST(hour(hour_ts) AS INT) AS hour, CAST(isodow(hour_ts) - 1 AS INT) AS day_of_week, CAST(month(hour_ts) AS INT) AS month, CAST(isodow(hour_ts) >= 6 AS INT) AS is_weekend,
  CAST(CAST(hour_ts AS DATE) IN (SELECT date FROM holidays) AS INT) AS is_holiday FROM win""")
def scoring_window(spark: SparkSession, d: str) -> DataFrame:
    return scoring.next_window(_panel(spark, d), _holidays(spark), 48)[1].withColumn("y", F.col("y").cast("double"))


def mean_of_window(pdf):
    """A stand-in model of one key: the mean of the window for the row without a value."""
    y = pdf["y"].dropna()
    row = pdf.iloc[-1:]
    return row.assign(prediction=float(y.mean()), p10=float(y.quantile(0.1)), p90=float(y.quantile(0.9)))[["hour_ts", "prediction", "p10", "p90"]]


def packaged_mean(spark: SparkSession) -> packaged.Artifact:
    """A packaged stand-in model, saved and published: the same forecasts, for all keys of a batch at once."""
    path = os.path.join(tempfile.mkdtemp(prefix="spark-model-"), "mean.zip")
    packaged.save(packaged.WindowQuantiles(), path, {"key": "bigint", "hour_ts": "timestamp_ntz", "y": "int"}, {"key": "bigint", "hour_ts": "timestamp_ntz", "prediction": "double", "p10": "double", "p90": "double"})
    return packaged.publish(spark, path)


@query(f"WITH {WINDOW_SQL} SELECT key, max(hour_ts) AS hour_ts, round(avg(y), 6) AS prediction, round(quantile_cont(CAST(y AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(y AS DOUBLE), 0.9), 6) AS p90, 'mean' AS model, '1' AS model_version, TIMESTAMP '2024-01-31' AS scored_at FROM win GROUP BY 1")
def next_hour(spark: SparkSession, d: str) -> DataFrame:
    """The hour after the data by a packaged model, from features of the window alone."""
    window = scoring.next_window(_panel(spark, d), _holidays(spark), 48)[1]
    out = packaged.score_batches(window, packaged_mean(spark))
    return rounded(scoring.stamped(out, "mean", "1", datetime(2024, 1, 31)), "prediction", "p10", "p90")


@query(f"WITH {WINDOW_SQL} SELECT key, max(hour_ts) AS hour_ts, round(avg(y), 6) AS prediction, round(quantile_cont(CAST(y AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(y AS DOUBLE), 0.9), 6) AS p90 FROM win GROUP BY 1")
def next_hour_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The same by a function that sees one key at a time."""
    return rounded(scoring.score(scoring.next_window(_panel(spark, d), _holidays(spark), 48)[1], mean_of_window), "prediction", "p10", "p90")
