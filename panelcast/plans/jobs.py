"""Queries of whole jobs: files of drifting schemas, text reports, sinks that are read back, the streaming feed, the scoring job."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.functions import scalars
from panelcast.operators import boosting, evaluate, features, importance, models, observations, panel, runs, scoring
from panelcast.operators.asof import asof_join
from panelcast.plans import queries as q
from panelcast.plans.queries import FORECAST_SQL, HISTORY_SQL, NAIVE_NAMED_SQL, PANEL_A, REPORT_SQL, WINDOW_SQL, query, r, rounded
from panelcast.sources import adapters, ingest, sinks
from panelcast.sources.adapters import SPLITS, table
from panelcast.streaming import counts

# ----------------------------------------------------------------------- files


@query("SELECT CAST(l_partkey % 270 AS INT) AS zone, count(*) AS n, round(sum(CASE WHEN l_linestatus = 'O' THEN l_tax END), 4) AS fee, count(*) FILTER (WHERE l_linestatus = 'F') AS without_fee FROM lineitem GROUP BY 1")
def drifted_files(spark: SparkSession, d: str) -> DataFrame:
    """Line items in files of two schemas, other names, cases and types in each, read as one table."""
    lines, path = table(spark, d, "lineitem"), sinks.shared_folder(spark)
    zone = F.col("l_partkey") % 270
    sinks.overwrite(lines.filter("l_linestatus = 'O'").select(zone.cast("double").alias("PULocationID"), F.col("l_tax").alias("Airport_Fee")), f"{path}/o")
    sinks.overwrite(lines.filter("l_linestatus = 'F'").select(zone.cast("int").alias("pulocationid")), f"{path}/f")
    spec = {"zone": ("int", ("PULocationID",)), "fee": ("double", ("airport_fee",))}
    rows = ingest.read_normalized(spark, [f"{path}/o", f"{path}/f"], spec)
    return rows.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.sum("fee"), 4).alias("fee"), F.count_if(F.col("fee").isNull()).alias("without_fee"))


TEXT_SQL = """
texts AS (
  SELECT event_type AS kind, CASE WHEN event_id % 19 <> 0 THEN date_trunc('second', ts) END AS obs_ts, CASE WHEN event_id % 17 = 0 THEN 'M' WHEN event_id % 13 = 0 THEN 'T'
    WHEN event_id % 11 = 0 THEN CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) || 's' ELSE CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) END AS amount FROM events),
once AS (SELECT obs_ts, min(amount) AS amount FROM texts WHERE kind = 'click' AND obs_ts IS NOT NULL GROUP BY 1),
numbers AS (
  SELECT (date_trunc('hour', obs_ts + INTERVAL 9 MINUTE) + INTERVAL 5 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS hour_ts,
    TRY_CAST(regexp_extract(amount, '^-?[0-9]+([.][0-9]+)?') AS DOUBLE) AS temp, CASE WHEN amount = 'T' THEN 0.001 ELSE TRY_CAST(regexp_extract(amount, '^-?[0-9]+([.][0-9]+)?') AS DOUBLE) END AS precip FROM once)"""


@query(f"WITH {TEXT_SQL} SELECT hour_ts, round(avg(temp), 6) AS temp, round(max(precip), 6) AS precip FROM numbers GROUP BY 1")
def clean_reports(spark: SparkSession, d: str) -> DataFrame:
    """Events as CSV texts in standard time, some without a time, read back and cleaned into hours by wall clock."""
    path = sinks.shared_folder(spark)
    rows = adapters.reports(spark, d)
    stamp = F.when(F.col("event_id") % 19 == 0, F.lit("no time")).otherwise(F.date_format("obs_ts", "yyyy-MM-dd'T'HH:mm:ss"))
    rows.select(stamp.alias("DATE"), F.col("report_type").alias("REPORT_TYPE2"), F.col("amount").alias("HourlyTemp"), F.concat(F.col("amount"), F.lit(" ")).alias("HourlyPrecip")).write.option("header", True).csv(path)
    measures = {"temp": ("HourlyTemp", None), "precip": ("HourlyPrecip", 0.001)}
    return rounded(observations.clean_reports(ingest.read_text_table(spark, [path]), "click", measures, ["precip"]), "temp", "precip")


@query("SELECT l_suppkey AS key, min(CASE WHEN l_linenumber <= 4 THEN make_date(1990 + l_linenumber, CAST(l_partkey % 12 + 1 AS INT), 1) END) AS first_month FROM lineitem GROUP BY 1")
def month_of(spark: SparkSession, d: str) -> DataFrame:
    """Months out of numbers; month 13 of the later lines is none."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), (1990 + F.col("l_linenumber")).alias("year"), F.when(F.col("l_linenumber") <= 4, F.col("l_partkey") % 12 + 1).otherwise(13).cast("int").alias("month"))
    return rows.groupBy("key").agg(F.min(scalars.month_of("year", "month")).alias("first_month"))


def _holiday_sql() -> str:
    fixed = " ".join(f"WHEN month(t) = {m} AND day(t) = {d} THEN '{n.replace(chr(39), chr(39) * 2)}'" for m, d, n in ingest.FIXED)
    moving = " ".join(f"WHEN month(t) = {m} AND isodow(t) = {w + 1} AND " + ("day(t) > day(last_day(t)) - 7" if k < 0 else f"(day(t) + 6) // 7 = {k}") + f" THEN '{n.replace(chr(39), chr(39) * 2)}'" for m, w, k, n in ingest.MOVING)
    return f"""days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1990-12-01', TIMESTAMP '2001-01-31', INTERVAL 1 DAY)) AS DATE) AS t),
  own AS (SELECT t AS date, CASE {fixed} {moving} END AS holiday_name FROM days
    UNION ALL SELECT CASE isodow(t) WHEN 6 THEN t - 1 ELSE t + 1 END, CASE {fixed} END || ' (observed)' FROM days WHERE isodow(t) >= 6
    UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), 'Busiest day' FROM orders WHERE day(o_orderdate) = 13 AND month(o_orderdate) = 3),
  holidays AS (SELECT date, min(holiday_name) AS holiday_name FROM own WHERE holiday_name IS NOT NULL AND year(date) BETWEEN 1991 AND 2000 GROUP BY 1)"""


@query(f"WITH {_holiday_sql()} SELECT holiday_name, count(*) AS n, count(DISTINCT date) AS days FROM orders JOIN holidays ON CAST(o_orderdate AS DATE) = date GROUP BY 1")
def holiday_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by holiday, observed days and days of a table of the caller's included."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    extra = orders.filter((F.dayofmonth("date") == 13) & (F.month("date") == 3)).distinct().withColumn("holiday_name", F.lit("Busiest day"))
    days = ingest.holidays(spark, 1991, 2000, observed=True, extra=extra)
    return orders.join(days, "date").groupBy("holiday_name").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"))


# ----------------------------------------------------------------------- sinks


@query("SELECT o_orderpriority AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, true AS there FROM orders GROUP BY 1")
def append_and_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """A table that is overwritten, schema and all, and then appended to."""
    orders, path = table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), sinks.shared_folder(spark)
    sinks.overwrite(orders.select(F.lit("old").alias("other")), path)
    sinks.overwrite(orders.filter("o_orderkey % 2 = 0"), path)
    sinks.append(orders.filter("o_orderkey % 2 <> 0"), path)
    there = F.lit(sinks.exists(spark, path) and not sinks.exists(spark, f"{path}-none"))
    return spark.read.parquet(path).groupBy(F.col("o_orderpriority").alias("part")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"), F.first(there).alias("there"))


@query("SELECT o_orderpriority AS part, count(*) AS n, true AS deleted, true AS dropped FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def delete_and_drop(spark: SparkSession, d: str) -> DataFrame:
    """A table of slices that loses one, and one that is dropped."""
    orders, path = table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), sinks.shared_folder(spark)
    sinks.replace_slice(orders, path, "o_orderpriority", ("o_orderkey",))
    deleted = sinks.delete_slice(spark, path, "o_orderpriority", "1-URGENT")
    sinks.append(orders, f"{path}-other")
    dropped = sinks.drop_table(spark, f"{path}-other") and not sinks.exists(spark, f"{path}-other")
    return spark.read.parquet(path).groupBy(F.col("o_orderpriority").alias("part")).agg(F.count("*").alias("n"), F.first(F.lit(deleted)).alias("deleted"), F.first(F.lit(dropped)).alias("dropped"))


@query("SELECT user_id AS key, date_trunc('hour', ts) AS hour_ts, count(*) AS y FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2")
def hourly_feed(spark: SparkSession, d: str) -> DataFrame:
    """The streaming feed over the events file: hours that the watermark has closed, each replaced as a whole."""
    path = sinks.shared_folder(spark)
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d).select(F.col("user_id").alias("key"), "ts")
    counts.feed(counts.hourly_counts(stream), f"{path}/out", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("key", F.col("hour_ts").cast("timestamp_ntz").alias("hour_ts"), "y")


@query(f"""WITH {FORECAST_SQL} SELECT model, key, hour_ts, y, round(round(prediction * 10) / 10, 1) AS prediction, round(ceil(p10 * 10) / 10, 1) AS p10, round(floor(p90 * 10) / 10, 1) AS p90,
  true AS in_order FROM forecasts""")
def export(spark: SparkSession, d: str) -> DataFrame:
    """The compact export as it was written: narrow values, zstd, and whether each row comes after the one before it in its file by model, hour and key."""
    path = sinks.shared_folder(spark)
    sinks.export(q._forecasts(spark, d), path)
    back = spark.read.parquet(path).select("*", "_metadata.file_path", "_metadata.row_index")
    place = F.struct("model", "hour_ts", "key")
    before = F.lag(place).over(Window.partitionBy("file_path").orderBy("row_index"))
    narrow = {c: F.round(F.col(c).cast("double"), 1) for c in ("prediction", "p10", "p90")}
    return back.withColumn("in_order", before.isNull() | (before <= place)).withColumns(narrow | {"y": F.col("y").cast("int")}).drop("file_path", "row_index")


# -------------------------------------------------------------------- operators


@query(f"WITH {PANEL_A}, busy AS (SELECT key FROM panel WHERE hour_ts < TIMESTAMP '2024-01-20' GROUP BY 1 HAVING sum(y) >= 2.0 * 19) SELECT key, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS total FROM panel JOIN busy USING (key) GROUP BY 1")
def restricted_panel(spark: SparkSession, d: str) -> DataFrame:
    p = q._panel(spark, d)
    kept = panel.restrict(p, panel.active_keys(p, *SPLITS.bounds("train"), min_daily=2.0))
    return kept.groupBy("key").agg(F.count("*").alias("n_rows"), F.sum("y").alias("total"))


@query(f"WITH {REPORT_SQL} SELECT report_type, CAST(obs_ts AS DATE) AS day, min(amount) AS amount FROM reports GROUP BY 1, 2")
def first_report_of_day(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.reports(spark, d).withColumn("day", F.to_date("obs_ts"))
    return observations.latest_by(rows, ["report_type", "day"], ["amount", "event_id"]).select("report_type", "day", "amount")


@query(f"WITH {PANEL_A},{HISTORY_SQL} SELECT key, hour_ts, round(ln(1 + CAST(lag_168h AS DOUBLE)), 6) AS log_lag_168h, round(ln(1 + 100 * greatest(roll_mean_24h - 1, 0)), 6) AS tight, CAST(hour(hour_ts) = 5 AS DOUBLE) AS hour_5 FROM history WHERE hour_ts >= TIMESTAMP '2024-01-25'")
def compressed_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of the learners: log1p of history, compressed amounts, one-hot hours."""
    lo, hi = SPLITS.bounds("test")
    feats = features.build(q._panel(spark, d), q._holidays(spark), start=lo, end=hi)
    new = {"log_lag_168h": F.log1p(F.col("lag_168h").cast("double")), "tight": scalars.compressed(F.col("roll_mean_24h") - 1), **scalars.one_hot("hour", [5], "hour")}
    return rounded(feats.withColumns(new).select("key", "hour_ts", *new), "log_lag_168h", "tight")


@query(f"""WITH {PANEL_A}, w AS (SELECT key, CAST(y AS DOUBLE) AS y, hour_ts FROM panel WHERE hour_ts >= TIMESTAMP '2024-01-29')
  SELECT key, hour_ts, y, CAST(hour(hour_ts) + 0.5 AS DOUBLE) AS level FROM w UNION ALL SELECT DISTINCT key, TIMESTAMP '2024-01-31', CAST(NULL AS DOUBLE), CAST(23.5 AS DOUBLE) FROM w""")
def carried_window(spark: SparkSession, d: str) -> DataFrame:
    """The window of the hour after the data: the columns that are carried keep the last hour's values."""
    rows = q._panel(spark, d)
    target = scoring.latest_hour(rows) + timedelta(hours=1)
    feats = features.build(rows, q._holidays(spark), start=target - timedelta(hours=48), end=target).withColumn("level", F.col("hour") + F.lit(0.5))
    out = scoring.scoring_window(feats, q._holidays(spark), target, 48, ["level"])
    return out.select("key", "hour_ts", F.col("y").cast("double").alias("y"), F.col("level").cast("double").alias("level"))


ASOF_SQL = """
seen AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 89 <> 0 THEN user_id END AS key, CASE WHEN event_id % 101 <> 0 THEN ts END AS ts FROM events),
bought AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 83 <> 0 THEN o_custkey % 150 END AS key, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 7 % 43200 AS INT)) AS bought_at, max(o_orderkey) AS o_orderkey
  FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1, 2)"""


@query(f"""WITH {ASOF_SQL}, j AS (SELECT event_id, s.key, s.ts, bought_at, o_orderkey FROM seen s ASOF LEFT JOIN bought b ON s.key = b.key AND s.ts >= b.bought_at)
  SELECT event_id, key, ts, CASE WHEN ts - bought_at <= INTERVAL 36 HOUR THEN bought_at END AS bought_at, CASE WHEN ts - bought_at <= INTERVAL 36 HOUR THEN o_orderkey END AS o_orderkey FROM j""")
def asof_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the last order of its key in the 36 hours before: a key has a third of all rows, orders share times, keys and times are missing."""
    n, o = F.col("event_id"), F.col("o_orderkey")
    seen = table(spark, d, "events").select("event_id", F.when(n % 3 == 0, 0).when(n % 89 != 0, F.col("user_id")).cast("long").alias("key"), F.when(n % 101 != 0, F.col("ts")).alias("ts"))
    minutes = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(o_orderkey * 7 % 43200 AS int), 0)")
    bought = table(spark, d, "orders").select(F.when(o % 3 == 0, 0).when(o % 83 != 0, F.col("o_custkey") % 150).cast("long").alias("key"), F.when(o % 97 != 0, minutes).alias("bought_at"), "o_orderkey")
    return asof_join(seen, bought, ["key"], "ts", "bought_at", ["o_orderkey"], timedelta(hours=36))


# ------------------------------------------------------------------ evaluation


@query(f"WITH {FORECAST_SQL} SELECT count(*) AS n, CAST(0 AS DOUBLE) AS max_diff FROM forecasts WHERE model = 'quantile'")
def reconciled(spark: SparkSession, d: str) -> DataFrame:
    """A model's stored forecasts against the same forecasts made anew by the pluggable backtest."""
    path = sinks.shared_folder(spark)
    sinks.replace_slice(sinks.forecast_rows(q._quantile(spark, d), "quantile"), path, "model", ("key",))
    again = models.rolling_backtest(q._panel(spark, d), q.trailing_quantiles, *SPLITS.bounds("test"), context=168)
    return rounded(evaluate.reconcile_or_fail(spark.read.parquet(path), again), "max_diff")


@query(f"WITH {FORECAST_SQL} SELECT model, count(*) AS n FROM forecasts WHERE model IN ('quantile', 'unknown') GROUP BY 1")
def allowed_models(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.only_models(q._forecasts(spark, d), ["quantile", "unknown"]).groupBy("model").agg(F.count("*").alias("n"))


@query(f"""WITH {NAIVE_NAMED_SQL}, m AS (SELECT CASE WHEN group_name IS NULL THEN '' ELSE '_' || replace(group_name, ' ', '_') END AS g, {q.ROUNDED_METRICS} FROM scored GROUP BY GROUPING SETS ((), (group_name)))
  SELECT 'test_mae' || g AS metric, mae AS value FROM m UNION ALL SELECT 'test_rmse' || g, rmse FROM m UNION ALL SELECT 'test_wape' || g, wape FROM m""")
def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """Metrics out of the stored table; the naive model has no band, so no coverage is told."""
    path, f = sinks.shared_folder(spark), q._forecasts(spark, d)
    sinks.replace_slice(f, path, "model", ("key",))
    return rounded(evaluate.stored_results(spark, path, "naive", adapters.keys(spark, d), "group_name"), "value")


@query(f"WITH {WINDOW_SQL} SELECT key, max(hour_ts) AS hour_ts, round(avg(y), 6) AS prediction, round(quantile_cont(CAST(y AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(y AS DOUBLE), 0.9), 6) AS p90, 'mean' AS model, '1' AS model_version FROM win GROUP BY 1")
def next_hour_job(spark: SparkSession, d: str) -> DataFrame:
    """The scoring job end to end, run twice: the last hour is looked up, and the slice of the next one is replaced."""
    path, rows = sinks.shared_folder(spark), q._panel(spark, d)
    for version in ("0", "1"):
        scoring.score_next_hour(rows, q._holidays(spark), q.packaged_mean(spark), "mean", version, path, 48, datetime(2024, 1, 31))
    out = spark.read.parquet(path).select("key", F.col("hour_ts").cast("timestamp_ntz").alias("hour_ts"), "prediction", "p10", "p90", "model", "model_version")
    return rounded(out, "prediction", "p10", "p90")


def blended(rows: DataFrame) -> DataFrame:
    """A forecaster by formula, of history, calendar and the key: simple enough for SQL to compute."""
    return rows.withColumn("prediction", (0.5 * F.col("roll_mean_168h") + 0.3 * F.col("lag_168h") + 0.2 * F.col("scale")) * (1 - 0.1 * F.col("is_weekend")))


BLEND = "(0.5::DOUBLE * {past}.roll_mean_168h + 0.3::DOUBLE * {past}.lag_168h + 0.2::DOUBLE * {static}.scale) * (1 - 0.1::DOUBLE * {future}.is_weekend)"


def _losses_sql() -> str:
    cases = {"none": {}, "past": {"past": "d"}, "future": {"future": "d"}, "static": {"static": "d"}}
    one = lambda c: BLEND.format(**({"past": "r", "future": "r", "static": "r"} | c))
    parts = " UNION ALL ".join(f"SELECT '{g}' AS \"group\", avg(abs({one(c)} - r.y)) AS loss FROM dealt r JOIN r d ON d.n = r.source" for g, c in cases.items())
    # the stride: the first number from the golden section of n on that has no divisor in common with n
    return f"""WITH {PANEL_A},{HISTORY_SQL}, scales AS (SELECT key, greatest(avg(y), 0.1) AS scale FROM panel WHERE hour_ts < TIMESTAMP '2024-01-20' GROUP BY 1),
  r AS (SELECT row_number() OVER (ORDER BY key, hour_ts) - 1 AS n, y, lag_168h, roll_mean_168h, scale, CAST(isodow(hour_ts) >= 6 AS INT) AS is_weekend FROM history JOIN scales USING (key) WHERE hour_ts >= TIMESTAMP '2024-01-25'),
  size AS (SELECT count(*) AS n FROM r),
  ab AS (SELECT n, (n // 3) % n AS b, (SELECT min(x) FROM (SELECT unnest(range(CAST(round(n * 0.6180339887) AS BIGINT), CAST(round(n * 0.6180339887) AS BIGINT) + 1000)) AS x) t WHERE gcd(x, n) = 1) AS a FROM size),
  dealt AS (SELECT r.*, (r.n * ab.a + ab.b) % ab.n AS source FROM r, ab),
  losses AS ({parts})
  SELECT "group", round(loss, 6) AS loss, round(loss - (SELECT loss FROM losses WHERE "group" = 'none'), 6) AS increase FROM losses"""


@query(_losses_sql())
def permutation_losses(spark: SparkSession, d: str) -> DataFrame:
    """Mean errors of a formula with its past, future or static inputs dealt to other rows, over all test rows."""
    lo, hi = SPLITS.bounds("test")
    p = q._panel(spark, d)
    feats = features.build(p, q._holidays(spark), start=lo, end=hi).join(features.key_scales(q._split(p, "train")), "key")
    rows, n = importance.numbered(feats.select("key", "hour_ts", "y", "lag_168h", "roll_mean_168h", "is_weekend", "scale"), "key", "hour_ts")
    groups = {"past": ["lag_168h", "roll_mean_168h"], "future": ["is_weekend"], "static": ["scale"]}
    return rounded(importance.permutation_losses(rows, n, groups, blended), "loss", "increase")


@query()
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """The same of the boosted model: pinball loss of its upper quantile with each group of inputs permuted."""
    feats, scales, model = q._boosted(spark, d)
    rows, n = importance.numbered(boosting.boost_inputs(q._split(feats, "test"), scales), "key", "hour_ts")
    left = F.col("y") - F.col("prediction")
    pinball = F.greatest(0.9 * left, -0.1 * left)
    return importance.permutation_losses(rows, n, boosting.BOOST_INPUTS, lambda df: boosting.predict_quantiles(model, df).withColumn("prediction", F.col("p90")), pinball)


def _run_log_sql() -> str:
    each = lambda kind, expr: f"SELECT model, 'test_{kind}' || g AS metric, round({expr}, 6) AS value FROM m"
    return f"""WITH {FORECAST_SQL},{q.KEYS_SQL}, s AS (SELECT f.*, group_name FROM forecasts f JOIN named USING (key)),
  m AS (SELECT model, CASE WHEN group_name IS NULL THEN '' ELSE '_' || replace(group_name, ' ', '_') END AS g, avg(abs(prediction - y)) AS mae, sqrt(avg((prediction - y) ** 2)) AS rmse, sum(abs(prediction - y)) / nullif(sum(y), 0) AS wape
    FROM s GROUP BY GROUPING SETS ((model), (model, group_name))),
  v AS ({each("mae", "mae")} UNION ALL {each("rmse", "rmse")} UNION ALL {each("wape", "wape")}
    UNION ALL SELECT model, 'test_coverage_p10_p90', round(avg(CAST(y >= p10 AND y <= p90 AS DOUBLE)), 6) FROM s WHERE p10 IS NOT NULL GROUP BY 1)
  SELECT model, 'test' AS "window", metric, value, CAST(1 AS BIGINT) AS n_runs FROM v WHERE value IS NOT NULL"""


@query(_run_log_sql())
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Test results of a model without a band and one with, logged twice each, as the run table has them."""
    path, log = sinks.shared_folder(spark), sinks.shared_folder(spark)
    sinks.replace_slice(q._forecasts(spark, d), path, "model", ("key",))
    for model in ("naive", "quantile", "naive", "quantile"):
        runs.log_test_results(spark, path, log, model, adapters.keys(spark, d), "group_name", datetime(2024, 1, 31), {"window": "test"})
    stored = spark.read.parquet(log)
    counts = stored.groupBy("model").agg(F.count("*").alias("n_runs"))
    rows = stored.select("model", F.col("tags")["window"].alias("window"), F.explode("metrics").alias("metric", "value"))
    return rounded(rows.join(counts, "model"), "value")
