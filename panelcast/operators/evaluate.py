"""Forecast errors, coverage and comparisons of models on the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _error() -> Column:
    return F.col("prediction") - F.col("y")


def metric_columns() -> list[Column]:
    """mae, rmse, wape (sum of |error| over sum of y; null when that is zero) and n."""
    return [F.avg(F.abs(_error())).alias("mae"), F.sqrt(F.avg(_error() * _error())).alias("rmse"), F.try_divide(F.sum(F.abs(_error())), F.sum("y")).alias("wape"), F.count("*").alias("n")]


def metrics(scored: DataFrame, *by: str | Column) -> DataFrame:
    return scored.groupBy(*by).agg(*metric_columns())


def metrics_with_total(scored: DataFrame, group: str, *by: str) -> DataFrame:
    """Metrics of each group and of all rows (group `overall`), from one pass by grouping sets."""
    cols = [F.col(c) for c in by]
    sets = [cols, [*cols, F.col(group)]]
    out = scored.groupingSets(sets, *cols, F.col(group)).agg(*metric_columns(), F.grouping(group).alias("__all"))
    return out.withColumn(group, F.when(F.col("__all") == 1, "overall").otherwise(F.col(group))).drop("__all")


def metrics_long(table: DataFrame, split: str, group: str, *by: str) -> DataFrame:
    """(metric, value) rows: test_wape for all rows, test_wape_<group> for a group, blanks as underscores."""
    long = table.unpivot([*by, group], ["mae", "rmse", "wape"], "kind", "value")
    name = F.concat(F.lit(split + "_"), F.col("kind"), F.when(F.col(group) == "overall", "").otherwise(F.concat(F.lit("_"), F.replace(F.col(group), F.lit(" "), F.lit("_")))))
    return long.select(*by, name.alias("metric"), "value")


def inside_band() -> Column:
    """Null where the model has no band: one missing bound is enough."""
    return F.when(F.col("p10").isNotNull() & F.col("p90").isNotNull(), F.col("y").between(F.col("p10"), F.col("p90")))


def coverage(scored: DataFrame, *by: str) -> DataFrame:
    """Share of rows inside the band; null, not zero, without one."""
    return scored.groupBy(*by).agg(F.avg(inside_band().cast("double")).alias("coverage"))


def board(forecasts: DataFrame) -> DataFrame:
    """wape, mae and coverage of each model, and its wape against the naive model's."""
    rows = forecasts.groupBy("model").agg(*metric_columns(), F.avg(inside_band().cast("double")).alias("coverage"))
    return rows.select("model", "wape", "mae", "coverage")


def against(board_: DataFrame, base: str) -> DataFrame:
    """Relative change of each model's wape to the base model's; a window over one row a model."""
    ref = F.max(F.when(F.col("model") == base, F.col("wape"))).over(Window.partitionBy())
    return board_.withColumn("vs_base", F.try_divide(F.col("wape"), ref) - 1)


def key_matrix(forecasts: DataFrame, models: list[str]) -> DataFrame:
    """wape of each key for each model as columns; the denominator is at least one."""
    return forecasts.groupBy("key").pivot("model", models).agg(F.sum(F.abs(_error())) / F.greatest(F.sum("y"), F.lit(1)))


def bias(forecasts: DataFrame, *by: str) -> DataFrame:
    """Total forecast over total actual, less one."""
    return forecasts.groupBy(*by).agg((F.try_divide(F.sum("prediction"), F.sum("y")) - 1).alias("bias"))


def by_hour(forecasts: DataFrame) -> DataFrame:
    return metrics(forecasts, "model", F.hour("hour_ts").alias("hour")).select("model", "hour", "wape", "n")


def day_kinds(forecasts: DataFrame, holidays: DataFrame) -> DataFrame:
    """day_kind: holiday, week_after (its date a week before is one, itself not), other."""
    h = F.broadcast(holidays.select("date").distinct())
    day = F.to_date("hour_ts")
    flagged = forecasts.join(h.select(F.col("date").alias("__h")), day == F.col("__h"), "left").join(h.select(F.col("date").alias("__w")), F.date_sub(day, 7) == F.col("__w"), "left")
    kind = F.when(F.col("__h").isNotNull(), "holiday").when(F.col("__w").isNotNull(), "week_after").otherwise("other")
    return flagged.withColumn("day_kind", kind).drop("__h", "__w")


def rank_buckets(forecasts: DataFrame, edges: tuple[int, ...]) -> DataFrame:
    """wape and share of volume by the rank of a key's volume; ranks up to each edge, then the rest.

    Only the keys up to the last edge are ranked; they are so few that their
    ranks are one small table. All other keys fall into the rest.
    """
    volume = forecasts.groupBy("key").agg(F.sum("y").alias("volume"))
    top = volume.orderBy(F.desc("volume"), "key").limit(edges[-1])
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("volume"), "key")))
    spans = list(zip((0, *edges), edges, strict=False))
    bucket = F.coalesce(*[F.when(F.col("rank") <= hi, F.lit(f"{lo + 1}-{hi}")) for lo, hi in spans])
    named = F.coalesce(F.col("bucket"), F.lit(f"over {edges[-1]}"))
    joined = forecasts.join(F.broadcast(ranked.select("key", bucket.alias("bucket"))), "key", "left").withColumn("bucket", named)
    out = joined.groupBy("model", "bucket").agg(F.try_divide(F.sum(F.abs(_error())), F.sum("y")).alias("wape"), F.sum("y").alias("volume"))
    return out.withColumn("share", F.try_divide(F.col("volume"), F.sum("volume").over(Window.partitionBy("model"))))


def common_rows(forecasts: DataFrame, n_models: int) -> DataFrame:
    """Rows whose (key, hour) every model has forecast."""
    shared = forecasts.groupBy("key", "hour_ts").agg(F.countDistinct("model").alias("m")).filter(F.col("m") == n_models).drop("m")
    return forecasts.join(shared, ["key", "hour_ts"], "left_semi")


def row_set_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one of the two has and the other has not, as often as they are missing."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows in common and the largest difference between two sets of predictions.

    The join merges: a set that was stored looks small by its compressed files.
    """
    both = a.select("key", "hour_ts", F.col("prediction").alias("pa")).join(b.select("key", "hour_ts", F.col("prediction").alias("pb")).hint("merge"), ["key", "hour_ts"])
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("pa") - F.col("pb"))).alias("max_diff"))


def reconcile_or_fail(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """`reconcile`, failing at run time when no row is in common or predictions differ by the tolerance or more."""
    out = reconcile(a, b)
    wrong = F.when(F.col("n") == 0, "no rows in common").when(F.col("max_diff") >= tolerance, F.concat(F.lit("predictions differ by "), F.col("max_diff").cast("string")))
    return out.withColumn("n", F.when(wrong.isNull(), F.col("n")).otherwise(F.raise_error(wrong).cast("long")))


def only_models(forecasts: DataFrame, models: list[str]) -> DataFrame:
    """Forecasts of the models that may be shown; an empty list shows none."""
    return forecasts.filter(F.col("model").isin(*models)) if models else forecasts.limit(0)


def stored_results(spark: SparkSession, path: str, model: str, keys: DataFrame, group: str) -> DataFrame:
    """Test metrics of a model's stored forecasts as (metric, value) rows, with the band's coverage where any row has a band.

    The join merges: stored forecasts look small by their compressed files.
    """
    rows = spark.read.parquet(path).filter(F.col("model") == model).join(keys.hint("merge"), "key")
    names = metrics_long(metrics_with_total(rows, group), "test", group).select("metric", "value")
    band = coverage(rows).select(F.lit("test_coverage_p10_p90").alias("metric"), F.col("coverage").alias("value")).filter("value IS NOT NULL")
    return names.unionByName(band)
