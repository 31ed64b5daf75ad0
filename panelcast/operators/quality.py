"""Ordered quality rules, their audit, and audits of a finished panel."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.config import Limits

Rules = list[tuple[str, Column]]


@dataclass(frozen=True)
class Bound:
    """What values a measure may have. `low` and `high` may be columns; whether a limit itself is valid is said by the brackets, `[` and `]` or `(` and `)`."""

    reason: str
    measure: Column
    low: object = None
    high: object = None
    brackets: str = "[]"
    required: bool = True
    banned: tuple = ()

    def broken(self) -> Column:
        """Whether a value lies outside; a missing one does if the measure is required."""
        ends = []
        if self.low is not None:
            ends.append(self.measure < self.low if self.brackets[0] == "[" else self.measure <= self.low)
        if self.high is not None:
            ends.append(self.measure > self.high if self.brackets[1] == "]" else self.measure >= self.high)
        if self.banned:
            ends.append(self.measure.isin(*self.banned))
        return reduce(Column.__or__, ends, self.measure.isNull() if self.required else F.lit(False))


def minutes_between(start: str, end: str) -> Column:
    """Whole seconds from start to end, in minutes."""
    return F.expr(f"(unix_timestamp({end}) - unix_timestamp({start})) / 60.0D")


def event_bounds(limits: Limits = Limits()) -> list[Bound]:
    """The bounds of an event, in the order in which they are tried. Reasons are fixed values; a reason may have several bounds.

    Needs pickup_ts, dropoff_ts, zone, distance, fare, total, file_month (its first day).
    """
    month = F.col("file_month")
    return [
        Bound("missing_timestamp", F.col("pickup_ts")),
        Bound("missing_timestamp", F.col("dropoff_ts")),
        Bound("pickup_outside_file_month", F.col("pickup_ts"), month.cast("timestamp_ntz"), F.add_months(month, 1).cast("timestamp_ntz"), "[)", required=False),
        Bound("unknown_pickup_zone", F.col("zone"), 1, limits.max_zone, banned=limits.unknown_zones),
        Bound("impossible_duration", minutes_between("pickup_ts", "dropoff_ts"), limits.min_minutes, limits.max_minutes, required=False),
        Bound("bad_distance", F.col("distance"), 0, limits.max_distance, "(]"),
        Bound("bad_fare", F.col("fare"), 0, limits.max_fare),
        Bound("bad_fare", F.col("total"), 0, required=False),
    ]


def event_rules(limits: Limits = Limits()) -> Rules:
    """(reason, condition) of each bound; a null condition does not fire."""
    return [(bound.reason, bound.broken()) for bound in event_bounds(limits)]


def first_failing(rules: Rules) -> Column:
    """The name of the first rule that fires, else null: each row has one reason at most."""
    return F.coalesce(*[F.when(fires, F.lit(reason)) for reason, fires in rules])


def tag(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn("drop_reason", first_failing(rules))


def keep_valid(tagged: DataFrame) -> DataFrame:
    return tagged.filter("drop_reason IS NULL").drop("drop_reason").withColumn("duration_min", minutes_between("pickup_ts", "dropoff_ts"))


def audit(tagged: DataFrame) -> DataFrame:
    """Rows and percentage for each reason, `kept` for none; one aggregation, and a window over its few rows."""
    counts = tagged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null, n_rows) of each column, from one aggregation."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return counts.unpivot(["n_rows"], columns, "column", "n_null").select("column", F.coalesce("n_null", F.lit(0)).alias("n_null"), "n_rows")


def panel_audit(panel: DataFrame, key: str = "key", ts: str = "hour_ts") -> DataFrame:
    """One row: rows, keys, hours, and whether rows are keys times hours."""
    return panel.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.countDistinct(ts).alias("n_hours")).withColumn("gap_free", F.col("n_rows") == F.col("n_keys") * F.col("n_hours"))
