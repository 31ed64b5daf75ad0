import time
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boosting, evaluate, features
from panelcast.sources import ingest

START = datetime(2024, 1, 1)


def hours(n):
    return START + timedelta(hours=n)


@pytest.fixture(scope="module")
def feats(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key in range(12):
        for h in range(24 * 30):
            level = 30 * (key + 1) * (1.5 + np.sin(2 * np.pi * h / 24))
            rows.append((key, hours(h), int(rng.normal(level, 0.2 * level))))
    df = spark.createDataFrame(rows, "key long, hour_ts timestamp_ntz, y int").repartition(3)
    return features.with_history(features.build(df, ingest.holidays(spark, 2024, 2024))).cache()


@pytest.fixture(scope="module")
def fitted(feats):
    train, validation = features.between(feats, START, hours(24 * 20)), features.between(feats, hours(24 * 20), hours(24 * 25))
    scales = features.key_scales(train)
    return scales, boosting.calibrate(boosting.fit_quantiles(train, scales, rounds=8), validation, scales)


def test_three_quantiles_cover_what_they_should(feats, fitted):
    scales, model = fitted
    test = features.between(feats, hours(24 * 25), hours(24 * 30))
    out = boosting.predict_quantiles(model, boosting.boost_inputs(test, scales)).cache()
    assert out.filter("p10 > prediction OR prediction > p90 OR p10 < 0").isEmpty() and out.count() == 12 * 120
    assert evaluate.coverage(out).first().coverage == pytest.approx(0.8, abs=0.03)
    below = out.agg(F.avg((F.col("y") < F.col("prediction")).cast("double"))).first()[0]
    assert below == pytest.approx(0.5, abs=0.05)
    assert evaluate.metrics(out).first().wape < 0.2
    # the band follows the level: it is wider where the noise is
    wide = {r.key: r.w for r in out.groupBy("key").agg(F.avg(F.col("p90") - F.col("p10")).alias("w")).collect()}
    assert wide[11] > 6 * wide[0]


def test_trees_lower_the_pinball_loss_with_each_round(feats, fitted):
    scales, model = fitted
    rows = boosting.boost_inputs(features.between(feats, START, hours(24 * 20)), scales).select(*boosting.INPUTS, "target").toPandas()
    x, y = rows[boosting.INPUTS].to_numpy(float), rows["target"].to_numpy(float)
    for k, q in enumerate(model.quantiles):
        losses = []
        for n in (0, 2, 4, 8):
            part = boosting.QuantileModel(model.quantiles, model.start, model.inputs, [t[:n] for t in model.trees])
            r = y - part.raw(k, x)
            losses.append(np.maximum(q * r, (q - 1) * r).mean())
        assert losses == sorted(losses, reverse=True) and losses[-1] < 0.8 * losses[0]


def test_leaf_values_are_percentiles_of_what_is_left(feats, fitted):
    scales, model = fitted
    rows = boosting.boost_inputs(features.between(feats, START, hours(24 * 20)), scales).select(*boosting.INPUTS, "target").toPandas()
    x, y = rows[boosting.INPUTS].to_numpy(float), rows["target"].to_numpy(float)
    for k, q in enumerate(model.quantiles):
        tree = model.trees[k][0]
        leaf = tree.leaves(x, False)
        for i in np.unique(leaf):
            r = np.sort(y[leaf == i] - model.start[k])
            v, off = tree.value[i] / 0.3, 1 / len(r) + 2 / boosting.ACCURACY
            below, upto = np.searchsorted(r, v - 1e-9, "left") / len(r), np.searchsorted(r, v + 1e-9, "right") / len(r)
            assert below - off <= q <= upto + off  # equal residuals share their ranks


def test_sql_recomputes_the_forecasts_from_the_table_of_trees(spark, feats, fitted, tmp_path):
    scales, model = fitted
    test = boosting.boost_inputs(features.between(feats, hours(24 * 29), hours(24 * 30)), scales)
    boosting.trees_table(spark, model).coalesce(1).write.parquet(f"file://{tmp_path}/trees")
    raw = test.withColumn("raw", boosting.raw_quantiles(model))
    raw.select("key", "hour_ts", *boosting.INPUTS, "raw").coalesce(1).write.parquet(f"file://{tmp_path}/rows")
    inputs = ", ".join(boosting.INPUTS)
    sql = f"""WITH RECURSIVE long AS (SELECT key, hour_ts, input, v FROM (UNPIVOT (SELECT key, hour_ts, {inputs} FROM read_parquet('{tmp_path}/rows/*.parquet')) ON {inputs} INTO NAME input VALUE v)),
      ids AS (SELECT DISTINCT key, hour_ts FROM long), trees AS (SELECT * FROM read_parquet('{tmp_path}/trees/*.parquet')),
      walk AS (SELECT key, hour_ts, quantile, tree, 0 AS node FROM ids, trees WHERE node = 0
        UNION ALL SELECT w.key, w.hour_ts, w.quantile, w.tree, CASE WHEN v <= threshold THEN 2 * w.node + 1 ELSE 2 * w.node + 2 END
        FROM walk w JOIN trees t USING (quantile, tree, node) JOIN long l ON l.key = w.key AND l.hour_ts = w.hour_ts AND l.input = t.input)
      SELECT key, hour_ts, quantile, sum(value) FROM walk JOIN trees USING (quantile, tree, node) WHERE value IS NOT NULL GROUP BY 1, 2, 3"""
    want = {(k, t, q): v for k, t, q, v in duckdb.sql(sql).fetchall()}
    got = {(r.key, r.hour_ts, q): v for r in raw.collect() for q, v in zip(model.quantiles, r.raw, strict=True)}
    assert len(want) == 12 * 24 * 3 and want.keys() == got.keys() and max(abs(want[k] - got[k]) for k in want) < 1e-9
    by_joins = {(r.key, r.hour_ts, r.quantile): r.raw for r in boosting.scored_by_table(boosting.trees_table(spark, model), test, 4).collect()}
    assert max(abs(by_joins[k] - got[k]) for k in got) < 1e-9


def test_gains_and_no_rows(spark, feats, fitted):
    scales, model = fitted
    shares = boosting.gains(model)
    assert sum(v for *_, v in shares) == pytest.approx(1) and {g for g, *_ in shares} == {"past", "future", "static"}
    empty = boosting.fit_quantiles(feats.limit(0), scales)
    assert boosting.predict_quantiles(empty, boosting.boost_inputs(feats.limit(3), scales)).count() == 3


def test_trees_are_followed_by_columns():
    """The same ends as looking up each row's input at each level, in less than half the time."""
    rng = np.random.default_rng(3)
    tree = boosting.Tree.of_depth(4)
    tree.input[:15], tree.bin[:15] = rng.integers(0, 13, 15), rng.integers(0, 31, 15)
    tree.input[4] = -1
    x = rng.integers(0, 32, (13, 300_000)).astype(np.uint8).T

    def by_row():
        at = np.zeros(len(x), np.int64)
        for _ in range(4):
            split = tree.input[at]
            left = x[np.arange(len(x)), np.maximum(split, 0)] <= tree.bin[at]
            at = np.where(split >= 0, 2 * at + 2 - left, at)
        return at

    def seconds(f):
        took = []
        for _ in range(5):
            begin = time.perf_counter()
            f()
            took.append(time.perf_counter() - begin)
        return min(took)

    assert (tree.leaves(x, True) == by_row()).all()
    assert seconds(lambda: tree.leaves(x, True)) < 0.5 * seconds(by_row)


def test_the_exported_table_meets_each_row_once_a_quantile(spark, feats, fitted):
    scales, model = fitted
    out = boosting.scored_by_table(boosting.trees_table(spark, model), boosting.boost_inputs(feats, scales).limit(50), 4)
    assert "Join [quantile" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 150
