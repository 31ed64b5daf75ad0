"""Gap-free panels of event counts, and the choice of series worth modelling."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalars import hour_of
from panelcast.operators.features import between
from panelcast.operators.observations import hour_spine


def counts(events: DataFrame, categories: dict[str, str] | None = None, key: str = "key", ts: str = "ts") -> DataFrame:
    """Events per key and hour, in all and for each category (column name -> value of `category`)."""
    each = [F.count_if(F.col("category") == v).alias(c) for c, v in (categories or {}).items()]
    return events.groupBy(F.col(key).alias("key"), hour_of(ts).alias("hour_ts")).agg(F.count("*").alias("y"), *each)


#: Rows of the grid that a task is given at most, about; few rows are spread over all cores, but not thinner than the least.
TASK_ROWS, LEAST_ROWS = 500_000, 20_000


def n_tasks(keys: DataFrame, hours: int) -> int:
    """How many tasks the grid of these keys takes, from an estimate of how many keys there are."""
    rows = keys.agg(F.approx_count_distinct("key")).first()[0] * hours
    return max(1, math.ceil(rows / TASK_ROWS), min(keys.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / LEAST_ROWS)))


def panel(events: DataFrame, keys: DataFrame, start: datetime, end: datetime, categories: dict[str, str] | None = None) -> DataFrame:
    """One row for every key and every hour in [start, end), zeros included.

    Events of keys that `keys` lacks, or outside the range, are not counted;
    the range prunes the scan. Keys and counts are dealt out by key before the
    grid is exploded, as rows of zeros that are added up with the counts, so the
    grid itself is not shuffled, and windows over a key's hours need no other
    shuffle. Both are added up where they are read, so few keys with many events
    are few rows. The number of tasks follows from the number of keys, which is counted
    first: coalescing by bytes would give a task any number of rows, as grids
    compress to next to nothing. A key has as many rows as there are hours, so none
    is large.
    """
    inside = events.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    names, n = ["y", *(categories or {})], n_tasks(keys, math.ceil((end - start) / timedelta(hours=1)))
    grid = hour_spine(keys.select("key").distinct().repartition(n, "key"), F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    zeros = grid.select("key", "hour_ts", *[F.lit(0).cast("long").alias(c) for c in names], F.lit(1).alias("__in_grid"))
    both = zeros.unionByName(counts(inside, categories).repartition(n, "key").withColumn("__in_grid", F.lit(0)))
    out = both.groupBy("key", "hour_ts").agg(*[F.sum(c).cast("int").alias(c) for c in names], F.max("__in_grid").alias("__in_grid"))
    return out.filter("__in_grid = 1").drop("__in_grid")


def active_keys(panel_: DataFrame, start: datetime, end: datetime, min_daily: float) -> DataFrame:
    """Keys with at least min_daily events a day on average in [start, end), the training window only."""
    days = (end - start) / timedelta(days=1)
    totals = between(panel_, start, end).groupBy("key").agg(F.sum("y").alias("total"))
    return totals.filter(F.col("total") >= F.lit(min_daily * days)).select("key", (F.col("total") / days).alias("avg_daily"))


def restrict(panel_: DataFrame, keys: DataFrame) -> DataFrame:
    return panel_.join(keys.select("key"), "key", "left_semi")
