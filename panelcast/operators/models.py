"""Forecasters: seasonal naive, empirical quantiles, a pluggable grouped backtest. The Poisson and the boosted model have modules of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.config import QUANTILES
from panelcast.operators.features import between
from panelcast.operators.keyed import changes, together, whole_keys
from panelcast.operators.poisson import PoissonModel, fit_poisson, predict_poisson  # noqa: F401  (one place for all models)
from panelcast.operators.sliding import range_percentiles

Forecaster = Callable[[pd.DataFrame], pd.DataFrame]


def seasonal_naive(features: DataFrame) -> DataFrame:
    """The value of the same hour a week before."""
    return features.withColumn("prediction", F.col("lag_168h").cast("double"))


#: Panel rows whose windows are judged at once, keys whole.
BATCH_ROWS = 131_072


def context_quantiles(panel: DataFrame, start: datetime, end: datetime, context: int = 168, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One-step forecasts of [start, end): p10, prediction and p90 are quantiles of the `context` hours before each.

    Only [start - context, end) is read. No window is sorted (`sliding`): the
    work per row does not grow with the context. A key has at most a row an
    hour; null values are left out of its windows.
    """
    window = between(panel.select("key", "hour_ts", "y"), start - timedelta(hours=context), end)
    kinds = dict(window.dtypes)
    first = np.datetime64(start, "us")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, 0, BATCH_ROWS):
            begins = np.array(changes(rows.column(0)), np.int64)
            key_start = np.repeat(begins, np.diff(np.append(begins, rows.num_rows)))
            at = np.flatnonzero(np.asarray(rows.column(1), "datetime64[us]") >= first)
            y = np.asarray(rows.column(2).cast(pa.float64()).fill_null(np.nan), np.float64)
            q = range_percentiles(y, np.maximum(key_start[at], at - context), at, quantiles)
            out = rows.select(["key", "hour_ts", "y"]).take(pa.array(at))
            for name, values in zip(("p10", "prediction", "p90"), q.T, strict=True):
                out = out.append_column(name, pa.array(values, mask=np.isnan(values)))
            yield from out.combine_chunks().to_batches()

    return together(window, "key", "hour_ts").mapInArrow(run, f"key {kinds['key']}, hour_ts {kinds['hour_ts']}, y {kinds['y']}, p10 double, prediction double, p90 double")


def rolling_backtest(panel: DataFrame, forecaster: Forecaster, start: datetime, end: datetime, context: int, chunk_hours: int = 24 * 28) -> DataFrame:
    """One-step forecasts by any model: forecaster(rows of one key, sorted) -> hour_ts, prediction, p10, p90.

    A key's hours are cut into chunks that each carry the `context` hours before
    them, so one very long series is many groups; a chunk whose first target has
    less context than that is an error. Predictions outside a chunk's own hours
    are dropped.
    """
    origin = F.lit(start).cast("timestamp_ntz")
    hours = F.expr("timestampdiff(HOUR, __origin, hour_ts)")
    rows = between(panel.select("key", "hour_ts", "y"), start - timedelta(hours=context), end).withColumn("__origin", origin).withColumn("__h", hours)
    first = F.greatest(F.floor(F.col("__h") / chunk_hours), F.lit(0))
    last = F.least(F.floor((F.col("__h") + context) / chunk_hours), F.lit(int((end - start).total_seconds() // 3600 - 1) // chunk_hours))
    spread = rows.withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, last)))).drop("__origin")
    kind = dict(panel.dtypes)["key"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hour_ts", ignore_index=True)
        own = (pdf["__h"] >= pdf["chunk"] * chunk_hours) & (pdf["__h"] < (pdf["chunk"] + 1) * chunk_hours)
        if not own.any():
            return pdf.iloc[:0].assign(prediction=0.0, p10=0.0, p90=0.0)[["key", "hour_ts", "y", "prediction", "p10", "p90"]]
        if own.to_numpy().argmax() < context:
            raise ValueError(f"key {pdf['key'].iloc[0]} has fewer than {context} hours before {pdf['hour_ts'][own.to_numpy().argmax()]}")
        found = forecaster(pdf[["key", "hour_ts", "y"]])
        out = pdf.loc[own, ["key", "hour_ts", "y"]].merge(found[["hour_ts", "prediction", "p10", "p90"]], on="hour_ts")
        band = out[["p10", "prediction", "p90"]].clip(lower=0)
        return out.assign(p10=band["p10"], prediction=band["prediction"], p90=band["p90"])[["key", "hour_ts", "y", "prediction", "p10", "p90"]]

    return spread.groupBy("key", "chunk").applyInPandas(run, f"key {kind}, hour_ts timestamp_ntz, y int, prediction double, p10 double, p90 double")


def contexts(panel: DataFrame, start: datetime, end: datetime, context: int) -> DataFrame:
    """For each target in [start, end) its `context` values strictly before it, oldest first; too short a history is an error."""
    w = Window.partitionBy("key").orderBy("hour_ts").rowsBetween(-context, -1)
    rows = between(panel.select("key", "hour_ts", "y"), start - timedelta(hours=context), end)
    out = between(rows.withColumn("context", F.collect_list("y").over(w)), start, end)
    return out.withColumn("context", F.when(F.size("context") == context, F.col("context")).otherwise(F.raise_error(F.lit("history is too short")).cast("array<int>")))
