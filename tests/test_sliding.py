import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import models, sliding

START = datetime(2024, 1, 1)
Q = (0.1, 0.5, 0.9)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(-3, 5).map(float), st.just(float("nan")), st.floats(-1e6, 1e6)), min_size=1, max_size=60), st.integers(1, 20))
def test_ranges_equal_sorting_each(values, context):
    v = np.array(values)
    at = np.arange(len(v) + 1)
    lo = np.maximum(0, at - context)
    got = sliding.range_percentiles(v, lo, at, Q)
    for i in at:
        part = v[lo[i] : i]
        part = part[~np.isnan(part)]
        want = np.quantile(part, Q) if len(part) else [np.nan] * 3
        assert got[i] == pytest.approx(want, nan_ok=True, rel=1e-9, abs=1e-9)


def test_equals_the_percentile_over_a_frame(spark):
    rng = np.random.default_rng(2)
    rows = [(k, START + timedelta(hours=h), None if rng.random() < 0.05 else int(rng.poisson(3 + 40 * (k == 2)))) for k in (None, 1, 2, 3) for h in range(150)]
    df = spark.createDataFrame(rows, "key long, hour_ts timestamp_ntz, y int").repartition(3)
    lo, hi = START + timedelta(hours=60), START + timedelta(hours=150)
    w = Window.partitionBy("key").orderBy("hour_ts").rowsBetween(-48, -1)
    q = F.percentile(F.col("y").cast("double"), F.array(*[F.lit(x) for x in Q])).over(w)
    want = {(r.key, r.hour_ts): r.q for r in df.filter(F.col("hour_ts") >= F.lit(lo - timedelta(hours=48)).cast("timestamp_ntz")).withColumn("q", q).collect()}
    old = models.BATCH_ROWS
    for size in (old, 100):
        models.BATCH_ROWS = size
        got = models.context_quantiles(df, lo, hi, 48).collect()
        assert len(got) == 4 * 90 and all((r.p10, r.prediction, r.p90) == pytest.approx(tuple(want[r.key, r.hour_ts])) for r in got)
    models.BATCH_ROWS = old


def test_a_longer_context_takes_no_longer():
    rng = np.random.default_rng(3)
    y = rng.poisson(30, 400_000).astype(float)
    at = np.arange(len(y))

    def seconds(context):
        began = time.perf_counter()
        sliding.range_percentiles(y, np.maximum(0, at - context), at, Q)
        return time.perf_counter() - began

    seconds(168)
    assert min(seconds(512) for _ in range(3)) < 1.5 * min(seconds(168) for _ in range(3))
