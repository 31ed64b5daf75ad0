"""Report queries: busiest keys, shares, statuses, nearest hours, week slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.config import Bands


def top(df: DataFrame, by: str, n: int, tie: str = "key") -> DataFrame:
    """The n largest rows; ties by the smallest key."""
    return df.orderBy(F.desc(by), F.col(tie)).limit(n)


def status(bands: Bands = Bands()) -> Column:
    """Against the band: Above, Below, In range; without a band: Under-forecast, Over-forecast, On target."""
    y, p = F.col("y"), F.col("prediction")
    off = (p - y) / F.greatest(y, F.lit(1))
    banded = F.when(y > F.col("p90"), "Above").when(y < F.col("p10"), "Below").otherwise("In range")
    plain = F.when(off > bands.on_target, "Over-forecast").when(off < -bands.on_target, "Under-forecast").otherwise("On target")
    return F.when(F.col("p10").isNotNull() & F.col("p90").isNotNull(), banded).otherwise(plain)


def signed_error(bands: Bands = Bands()) -> Column:
    """Relative error with a floor of the denominator, cut to [-1, 1]."""
    return F.greatest(F.least((F.col("prediction") - F.col("y")) / F.greatest(F.col("y"), F.lit(bands.error_floor)), F.lit(1.0)), F.lit(-1.0))


def group_share(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Volume and share of each group, groups without rows included with zero."""
    volume = rows.groupBy("group_name").agg(F.sum("y").alias("volume"))
    all_groups = groups.select("group_name").distinct().join(volume, "group_name", "left").withColumn("volume", F.coalesce("volume", F.lit(0)))
    return all_groups.withColumn("share", F.try_divide(F.col("volume"), F.sum("volume").over(Window.partitionBy())))


def total_error(rows: DataFrame, *by: str) -> DataFrame:
    """Error of the sum over all keys, relative to the actual sum."""
    return rows.groupBy(*by).agg((F.try_divide(F.sum("prediction") - F.sum("y"), F.sum("y"))).alias("total_error"))


def nearest_hour(df: DataFrame, wanted: DataFrame, ts: str = "hour_ts") -> DataFrame:
    """For each wanted time the nearest hour that df has, the earlier of two.

    The candidates of a time are the last hour up to it and the first from it
    on, so both come from a union sorted by time, bucketed by day with the
    bounds of the days around carried over: no pair of all times and hours.
    """
    hours = df.select(F.col(ts).alias("t")).distinct().withColumn("is_hour", F.lit(True))
    both = hours.unionByName(wanted.select(F.col("wanted").alias("t")).distinct().withColumn("is_hour", F.lit(False)))
    both = both.withColumn("day", F.to_date("t"))
    known = F.when(F.col("is_hour"), F.col("t"))
    days = both.groupBy("day").agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    across = Window.orderBy("day")
    days = days.select("day", F.last("hi", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("hi"), F.first("lo", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("lo"))
    w = Window.partitionBy("day").orderBy("t", F.desc("is_hour"))
    found = both.join(days, "day").select(
        "is_hour",
        F.col("t").alias("wanted"),
        F.coalesce(F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("hi")).alias("before"),
        F.coalesce(F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("lo")).alias("after"),
    )
    gap = lambda a, b: F.expr(f"unix_micros(cast({a} AS timestamp)) - unix_micros(cast({b} AS timestamp))")
    nearer = F.when(F.col("after").isNull() | (gap("wanted", "before") <= gap("after", "wanted")), F.coalesce("before", "after")).otherwise(F.col("after"))
    return found.filter("NOT is_hour").select("wanted", nearer.alias(ts))


def week_around(df: DataFrame, centre: str, ts: str = "hour_ts", days: int = 7) -> DataFrame:
    """Rows of `days` days around a time, the window moved inside the hours that df has."""
    half = f"make_dt_interval(0, {days * 12}, 0, 0)"
    bounds = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    start = F.expr(f"greatest(lo, least(timestamp_ntz'{centre}' - {half}, hi - make_dt_interval({days}, -1, 0, 0)))")
    bounds = bounds.select(start.alias("__from"))  # one row
    return df.crossJoin(F.broadcast(bounds)).filter((F.col(ts) >= F.col("__from")) & (F.col(ts) < F.expr(f"__from + make_dt_interval({days}, 0, 0, 0)"))).drop("__from")
