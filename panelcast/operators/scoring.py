"""Scoring of the next hour: the window that a model sees, grouped scoring, and the job."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.features import CALENDAR, add_calendar, between, build
from panelcast.operators.models import Forecaster
from panelcast.operators.packaged import Artifact, score_batches
from panelcast.sources.sinks import replace_slice


def latest_hour(panel: DataFrame) -> datetime:
    return panel.agg(F.max("hour_ts")).first()[0]


def scoring_window(features: DataFrame, holidays: DataFrame, target: datetime, input_hours: int, carried: list[str] = ()) -> DataFrame:
    """The input_hours before the target and the target's own row, without its value.

    Each key's target row is made from its last row up to the target: from the
    target hour itself if features have it, calendar included, else from the hour
    before, with `carried` columns as they were and the calendar of the clock. A
    key that has neither hour is left out.
    """
    hour = F.lit(target).cast("timestamp_ntz")
    kept = ["key", "hour_ts", "y", *CALENDAR, *carried]
    seen = between(features, target - timedelta(hours=input_hours), target + timedelta(hours=1)).select(*kept)
    near = between(seen, target - timedelta(hours=1), target + timedelta(hours=1))
    last = near.groupBy("key").agg(F.max_by(F.struct("hour_ts", *CALENDAR, *carried), "hour_ts").alias("last"))
    clocked = add_calendar(last.withColumn("hour_ts", hour), holidays)
    calendar = [F.when(F.col("last.hour_ts") == hour, F.col(f"last.{c}")).otherwise(F.col(c)).cast(features.schema[c].dataType).alias(c) for c in CALENDAR]
    row = clocked.select("key", "hour_ts", F.lit(None).cast(features.schema["y"].dataType).alias("y"), *calendar, *[F.col(f"last.{c}").alias(c) for c in carried])
    return seen.filter(F.col("hour_ts") < hour).unionByName(row)


def next_window(panel: DataFrame, holidays: DataFrame, input_hours: int, hour: datetime | None = None, carried: list[str] = ()) -> tuple[datetime, DataFrame]:
    """The hour to forecast and its window, out of a panel: `hour`, or the one after the panel's last.

    Only the hours of the window and the longest lag before them are read; the
    last hour comes from the panel itself, without features.
    """
    target = hour or latest_hour(panel) + timedelta(hours=1)
    feats = build(panel, holidays, start=target - timedelta(hours=input_hours), end=target + timedelta(hours=1))
    return target, scoring_window(feats, holidays, target, input_hours, carried)


def score_next_hour(panel: DataFrame, holidays: DataFrame, model: Forecaster | Artifact, name: str, version: str, path: str, input_hours: int, at: datetime, carried: list[str] = ()) -> datetime:
    """The job of the hour: forecast the hour after the last one of the panel, and replace that hour's slice of the table at path.

    The model is a packaged one, or a function of one key's rows. Returns the
    hour. Running it again writes the same slice anew.
    """
    target, window = next_window(panel, holidays, input_hours, carried=carried)
    scored = score_batches(window, model) if isinstance(model, Artifact) else score(window, model)
    replace_slice(stamped(scored, name, version, at), path, "hour_ts", ("key",))
    return target


def score(window: DataFrame, forecaster: Forecaster, n_groups: int | None = None) -> DataFrame:
    """Forecast the row without a value of each key; forecaster(rows of one key, sorted) -> hour_ts, prediction, p10, p90.

    With n_groups, keys are dealt to that many tasks, which adaptive coalescing leaves alone.
    """
    kind = dict(window.dtypes)["key"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = forecaster(pdf.sort_values("hour_ts", ignore_index=True))
        return found.assign(key=pdf["key"].iloc[0])[["key", "hour_ts", "prediction", "p10", "p90"]]

    rows = window.repartition(n_groups, "key") if n_groups else window
    return rows.groupBy("key").applyInPandas(run, f"key {kind}, hour_ts timestamp_ntz, prediction double, p10 double, p90 double")


def stamped(scored: DataFrame, model: str, version: str, at: datetime) -> DataFrame:
    """Scored rows with who made them and when; a repeated key fails."""
    once = F.when(F.count("*").over(_per_key()) == 1, F.col("key")).otherwise(F.raise_error(F.lit("a key is scored twice")).cast(scored.schema["key"].dataType))
    return scored.withColumns({"key": once, "model": F.lit(model), "model_version": F.lit(version), "scored_at": F.lit(at).cast("timestamp_ntz")})


def _per_key():
    from pyspark.sql import Window

    return Window.partitionBy("key", "hour_ts")
