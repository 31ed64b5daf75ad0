"""Hourly observations from irregular reports: parse, move to wall-clock hours, collapse, fill gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import scalars
from panelcast.sources.ingest import column_like


def latest_by(df: DataFrame, keys: list[str], tie_break: list[str]) -> DataFrame:
    """One row a key, the first by all of tie_break: unlike an arbitrary row, the same one in every run."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in tie_break])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def hourly(reports: DataFrame, hour: Column, means: list[str], maxima: list[str] = ()) -> DataFrame:
    """One row an hour: reports that share a wall-clock hour collapse to their mean, or maximum for `maxima`."""
    return reports.groupBy(hour.alias("hour_ts")).agg(*[F.avg(c).alias(c) for c in means], *[F.max(c).alias(c) for c in maxima])


def clean_reports(raw: DataFrame, report: str, measures: dict[str, tuple[str, float | None]], maxima: list[str] = (), zone: str = "America/New_York", type_prefix: str = "REPORT_TYPE", time: str = "DATE") -> DataFrame:
    """Hourly observations by wall clock out of raw text reports in local standard time.

    Reports of one type count; each time once, by the first of its texts in
    order, so every run keeps the same one. `measures` names each result, its raw
    column and the value of a trace. A report informs the first full hour after
    it; hours that autumn repeats collapse to means, or maxima for `maxima`.
    Texts that are no number and times that are none become null; reports
    without a time go.
    """
    kind = column_like(raw, type_prefix)
    texts = [source for source, _ in measures.values()]
    timed = raw.filter(F.trim(kind) == report).select(scalars.timestamp_of(time).alias("obs_ts"), *texts).filter("obs_ts IS NOT NULL")
    parsed = latest_by(timed, ["obs_ts"], texts).select("obs_ts", *[scalars.measure(source, trace).alias(name) for name, (source, trace) in measures.items()])
    return hourly(parsed, scalars.standard_to_wall_hour("obs_ts", zone), [m for m in measures if m not in maxima], list(maxima))


def hour_spine(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every hour in [start, end) for each row of df; no join, rows stream out."""
    return df.withColumn("hour_ts", F.explode(F.sequence(start, end - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))))


def forward_fill(df: DataFrame, columns: list[str], by: list[str] = (), ts: str = "hour_ts") -> DataFrame:
    """Each null takes the column's last known value before it (within `by`); leading nulls stay.

    In two levels, so that no task sorts a whole series: days are filled inside
    themselves in parallel; what enters a day is carried over a table with one
    row a day.
    """
    day = F.to_date(ts).alias("__day")
    by = list(by)
    ends = df.groupBy(*by, day).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"__end_{c}") for c in columns])
    across = Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "__day", *[F.last(f"__end_{c}", ignorenulls=True).over(across).alias(f"__in_{c}") for c in columns])
    within = Window.partitionBy(*by, "__day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("__day", F.to_date(ts)).join(carried, [*by, "__day"], "left")
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"__in_{c}")) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def fill_gaps(observed: DataFrame, spine: DataFrame, columns: list[str], wet: str | None = None) -> DataFrame:
    """Observations on every hour of the spine, gaps forward-filled; is_raining is 1 where `wet` is positive, null with it."""
    out = forward_fill(spine.join(observed, "hour_ts", "left"), columns)
    return out.withColumn("is_raining", (F.col(wet) > 0).cast("int")) if wet else out
