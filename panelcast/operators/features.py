"""Feature tables: history strictly before the hour, calendar, observations, dimension; encodings for learners."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.config import LAGS, ROLLING
from panelcast.functions import scalars

HISTORY = [*LAGS, *ROLLING]
CALENDAR = ["hour", "day_of_week", "month", "is_weekend", "is_holiday"]


def between(df: DataFrame, start: datetime, end: datetime, ts: str = "hour_ts") -> DataFrame:
    """Rows in the half-open range; as plain comparisons, so they reach a scan."""
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def add_history(panel: DataFrame, lags: dict[str, int] = LAGS, rolling: dict[str, int] = ROLLING, y: str = "y") -> DataFrame:
    """Lags and trailing means that exclude the row itself; row offsets are hours, as the panel has no gaps.

    Trailing means come from running sums, (sum before t - sum before t - k) /
    rows: exact for integer targets, and the work per row does not grow with k.
    All columns share one window specification, so one shuffle and one sort.
    """
    w = Window.partitionBy("key").orderBy("hour_ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    with_sums = panel.withColumns({"__sum": F.coalesce(F.sum(F.col(y).cast("long")).over(so_far), F.lit(0)), "__n": F.count("*").over(so_far)}) if rolling else panel
    means = {name: F.try_divide(F.col("__sum") - F.lag("__sum", k, 0).over(w), F.least(F.col("__n"), F.lit(k))) for name, k in rolling.items()}
    return with_sums.withColumns({name: F.lag(y, k).over(w) for name, k in lags.items()} | means).drop("__sum", "__n")


def add_calendar(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Calendar columns and is_holiday. Holidays have at most one row a date, 366 a year."""
    days = holidays.select(F.col("date").alias("__date")).distinct()
    joined = df.withColumns(scalars.calendar("hour_ts")).join(F.broadcast(days), F.to_date("hour_ts") == F.col("__date"), "left")
    return joined.withColumn("is_holiday", F.col("__date").isNotNull().cast("int")).drop("__date")


def build(panel: DataFrame, holidays: DataFrame, observed: DataFrame | None = None, keys: DataFrame | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The feature table of [start, end), or of all hours.

    A time filter cannot pass a window by itself; the longest lag bounds how far
    back a row looks, so earlier hours are cut off before the windows and the
    rest after them. Observations have a row an hour and keys a row a key;
    whether they are broadcast is left to their size.
    """
    if start is not None and end is not None:
        panel = between(panel, start - timedelta(hours=1 + max([*LAGS.values(), *ROLLING.values()])), end)
    out = add_calendar(add_history(panel), holidays)
    if observed is not None:
        out = out.join(observed, "hour_ts", "left")
    if keys is not None:
        out = out.join(keys, "key", "left")
    return between(out, start, end) if start is not None and end is not None else out


def with_history(features: DataFrame) -> DataFrame:
    """Rows whose whole history is known."""
    return features.dropna(subset=HISTORY)


def key_scales(train: DataFrame, floor: float = 0.1) -> DataFrame:
    """Mean of each key's target over the training rows, not below the floor."""
    return train.groupBy("key").agg(F.greatest(F.avg("y"), F.lit(floor)).alias("scale"))


def column_scales(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of mean and sample deviation for each column (<c>_mean, <c>_std); a deviation of zero or null counts as one."""
    std = lambda c: F.coalesce(F.when(F.stddev_samp(c) != 0, F.stddev_samp(c)), F.lit(1.0))
    return train.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[std(c).alias(f"{c}_std") for c in columns])


def encode(features: DataFrame, scales: DataFrame, columns: DataFrame | None = None, standardize: list[str] = (), groups: list[str] = ()) -> DataFrame:
    """The long training frame: scaled target, cyclical calendar, standardized columns, one-hot group.

    A key without a scale is an error, raised when its row is reached. The
    column scales are one row.
    """
    out = features.join(scales, "key", "left")
    scale = F.when(F.col("scale").isNull(), F.raise_error(F.concat(F.lit("no scale for key "), F.col("key").cast("string"))).cast("double")).otherwise(F.col("scale"))
    new: dict[str, Column] = {"scale": scale, "y_scaled": F.col("y") / scale, **scalars.cyclical("hour", 24, "hour"), **scalars.cyclical("day_of_week", 7, "dow"), "hour_of_week": scalars.hour_of_week()}
    if columns is not None:
        out = out.crossJoin(F.broadcast(columns))
        new |= {f"{c}_z": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in standardize}
    if groups:
        new |= scalars.one_hot("group_name", list(groups), "group")
    return out.withColumns(new).drop(*[f"{c}_{s}" for c in standardize for s in ("mean", "std")])
