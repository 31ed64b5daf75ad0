"""Column functions: lenient parsing, wall-clock hours, calendar, encodings, quantile repair."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What stands for an amount too small to measure; the shape of a number that a text begins with.
TRACE = "T"
LEADING_NUMBER = r"^-?[0-9]+(?:[.][0-9]+)?"


def measure(c: Column | str, trace: float | None = None) -> Column:
    """The number that a messy text begins with, whatever follows it; `trace`, if given, for the trace mark; null for other texts."""
    text = F.trim(c)
    marks = {} if trace is None else {TRACE: trace}
    number = F.regexp_substr(text, F.lit(LEADING_NUMBER)).try_cast("double")
    return F.coalesce(*[F.when(text == mark, F.lit(value)) for mark, value in marks.items()], number)


def timestamp_of(c: Column | str) -> Column:
    """Wall-clock time out of a text such as 2024-01-10T00:51:00; null where it is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("timestamp_ntz")


def month_of(year: str, month: str) -> Column:
    """The first day of a month given by its numbers; null where there is no such month."""
    return F.expr(f"try_make_timestamp_ntz({year}, {month}, 1, 0, 0, 0)").cast("date")


def hour_of(c: str) -> Column:
    """The hour's start, in the type of c. date_trunc would turn a timestamp without zone into one with."""
    return F.expr(f"{c} - make_dt_interval(0, 0, minute({c}), extract(SECOND FROM {c}))")


def standard_to_wall_hour(c: str, zone: str, utc_offset_hours: int = -5, lead_minutes: int = 9) -> Column:
    """Wall-clock hour that a report in local standard time informs: the first full hour after it.

    A report up to lead_minutes before the hour counts for that hour. In autumn
    two standard hours map to one wall hour; in spring one wall hour is skipped.
    """
    ahead = f"({c} + INTERVAL {lead_minutes} MINUTES)"
    utc = f"{ahead} - make_dt_interval(0, {utc_offset_hours}, minute({ahead}), extract(SECOND FROM {ahead}))"
    return F.from_utc_timestamp(F.expr(f"cast({utc} AS timestamp)"), zone).cast("timestamp_ntz")


def calendar(ts: str) -> dict[str, Column]:
    """hour, day_of_week (0 is Monday), month, is_weekend."""
    dow = F.weekday(ts)
    return {"hour": F.hour(ts), "day_of_week": dow, "month": F.month(ts), "is_weekend": (dow >= 5).cast("int")}


def cyclical(c: Column | str, period: int, name: str) -> dict[str, Column]:
    angle = F.col(c) * F.lit(2 * math.pi / period) if isinstance(c, str) else c * F.lit(2 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def hour_of_week(dow: str = "day_of_week", hour: str = "hour") -> Column:
    return F.col(dow) * 24 + F.col(hour)


def compressed(c: Column | str) -> Column:
    """log1p of a hundredfold amount, negative ones as zero."""
    return F.log1p(F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(0.0)) * 100)


def repaired_quantiles(*quantiles: Column, scale: Column | None = None) -> Column:
    """Quantile forecasts times `scale`, in order and not below zero, as an array."""
    values = [q * scale if scale is not None else q for q in quantiles]
    return F.transform(F.array_sort(F.array(*values)), lambda q: F.greatest(q, F.lit(0.0)))


def one_hot(c: str, values: list[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{v}": (F.col(c) == v).cast("double") for v in values}
