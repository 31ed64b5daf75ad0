import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import features, poisson
from panelcast.operators.features import HISTORY
from panelcast.sources import ingest

START = datetime(2024, 1, 1)


def rows(n_keys, n_hours, seed):
    """Counts with a rate of hour, input and key, and history columns that are noise."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n_keys):
        for h in range(n_hours):
            warm = float(rng.normal())
            rate = math.exp(0.3 * math.sin(2 * math.pi * h / 24) + 0.4 * warm + (k % 7) / 3)
            t = START + timedelta(hours=h)
            out.append((k, t, int(rng.poisson(rate)), t.hour, t.weekday(), 0, warm if h % 50 else None, *[float(x) for x in rng.poisson(3, len(HISTORY))]))
    return out


SCHEMA = "key long, hour_ts timestamp_ntz, y int, hour int, day_of_week int, is_holiday int, warm double, " + ", ".join(f"{c} double" for c in HISTORY)


def plain_fit(data):
    """Newton's method on all weights and one indicator a key, in one dense matrix."""
    table = [r for r in data]
    keys = sorted({r[0] for r in table})
    hours = sorted({r[4] * 24 + r[3] for r in table})
    warm = [r[6] for r in table if r[6] is not None]
    mean = sum(warm) / len(warm)
    x = np.zeros((len(table), len(keys) + len(hours) + 1 + len(HISTORY)))
    for i, r in enumerate(table):
        x[i, keys.index(r[0])] = 1
        x[i, len(keys) + hours.index(r[4] * 24 + r[3])] = 1
        x[i, len(keys) + len(hours)] = mean if r[6] is None else r[6]
        x[i, len(keys) + len(hours) + 1 :] = np.log1p(r[7:])
    y, w = np.array([r[2] for r in table], float), np.zeros(x.shape[1])
    for _ in range(60):
        mu = np.exp(x @ w)
        w = w + np.linalg.lstsq((x * mu[:, None]).T @ x, x.T @ (y - mu), rcond=None)[0]
    return np.exp(x @ w)


def test_equals_newton_on_one_dense_matrix(spark):
    data = rows(5, 190, 1)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    model = poisson.fit_poisson(df, ("warm",))
    got = {(r.key, r.hour_ts): r.prediction for r in poisson.predict_poisson(model, df).collect()}
    want = plain_fit(data)
    assert max(abs(got[r[0], r[1]] - m) for r, m in zip(data, want, strict=True)) < 1e-5 * max(want)
    assert model.steps < 15


def test_sums_of_keys_and_hours_are_what_was_counted(spark, monkeypatch):
    monkeypatch.setattr(poisson, "RUN_ROWS", 100)
    df = spark.createDataFrame(rows(23, 100, 2), SCHEMA).repartition(4)
    out = poisson.predict_poisson(poisson.fit_poisson(df), df)
    for by in ("key", F.col("day_of_week") * 24 + F.col("hour")):
        worst = out.groupBy(by).agg(F.abs(F.sum("prediction") - F.sum("y")).alias("d")).agg(F.max("d")).first()[0]
        assert worst < 1e-6


def test_a_hundred_thousand_keys(spark):
    df = spark.range(100_000).selectExpr("id AS key", "explode(sequence(0, 3)) AS hour").selectExpr("key", "hour", "0 AS day_of_week", "0 AS is_holiday", "cast((key % 5 + 1) * (hour + 1) AS int) AS y", *[f"cast((key * {i} + hour) % 3 AS double) AS {c}" for i, c in enumerate(HISTORY)])
    model = poisson.fit_poisson(df)
    out = poisson.predict_poisson(model, df)
    assert out.select(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-3
    assert model.levels.count() == 100_000


def test_runs_reach_the_workers_a_few_at_a_time(spark):
    """An Arrow batch is held several times outside the heap of the executor, so none has all runs of a task."""
    arrow = spark._jvm.org.apache.spark.sql.util.ArrowUtils.rootAllocator()
    before = arrow.getPeakMemoryAllocation()
    df = spark.range(1000).selectExpr("id AS key", "explode(sequence(0, 399)) AS h").selectExpr("key", "cast(h % 24 AS int) AS hour", "cast(h div 24 % 7 AS int) AS day_of_week", "0 AS is_holiday", "cast(key % 5 + h % 3 AS int) AS y", *[f"cast((key * {i} + h) % 3 AS double) AS {c}" for i, c in enumerate(HISTORY)])
    poisson.fit_poisson(df, max_iter=1)
    assert arrow.getPeakMemoryAllocation() <= max(before, 16 << 20), arrow.getPeakMemoryAllocation()


def test_unknown_keys_unseen_counts_and_missing_history(spark):
    data = [r for r in rows(4, 60, 3)]
    data = [(*r[:2], 0, *r[3:]) if r[0] == 2 else r for r in data]
    df = spark.createDataFrame(data, SCHEMA)
    model = poisson.fit_poisson(df, ("warm",))
    out = poisson.predict_poisson(model, df.withColumn("key", F.when(F.col("key") == 3, 99).otherwise(F.col("key"))).withColumn("lag_1h", F.when(F.hour("hour_ts") == 5, F.lit(None)).otherwise(F.col("lag_1h"))))
    assert out.filter("key = 2").agg(F.max("prediction")).first()[0] == 0
    assert out.filter("key = 99 AND (prediction IS NULL OR prediction <= 0) AND hour <> 5").isEmpty()
    assert out.filter("hour = 5 AND prediction IS NOT NULL").isEmpty()
    nothing = poisson.fit_poisson(df.limit(0))
    assert nothing.overall == 0 and nothing.levels.count() == 0


@pytest.mark.parametrize("kind", ["string", "long"])
def test_keys_of_any_type(spark, kind):
    df = spark.createDataFrame(rows(3, 48, 4), SCHEMA).withColumn("key", F.concat(F.lit("" if kind == "long" else "k"), F.col("key")).cast(kind))
    assert {str(r.key) for r in poisson.fit_poisson(df).levels.collect()} == ({"0", "1", "2"} if kind == "long" else {"k0", "k1", "k2"})
