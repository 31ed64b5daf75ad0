import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelcast.operators.asof import asof_join

START = datetime(2024, 1, 1)


def at(m):
    return None if m is None else START + timedelta(minutes=m)


def plain(left, right, tolerance):
    table = {}
    for k, t, v in right:
        if k is not None and t is not None:
            table.setdefault(k, {}).setdefault(t, []).append(v)
    out = []
    for k, t, x in left:
        times = sorted(table.get(k, {})) if k is not None and t is not None else []
        i = bisect.bisect_right(times, t) - 1 if times else -1
        hit = times[i] if i >= 0 and (tolerance is None or t - times[i] <= tolerance) else None
        out.append((k, at(t), x, at(hit), None if hit is None else max(table[k][hit])))
    return sorted(out, key=str)


@pytest.mark.parametrize("tolerance", [None, 0, 300])
@pytest.mark.parametrize("bucket", [86_400, 3_600])
def test_equals_a_search_by_key(spark, tolerance, bucket):
    rng = random.Random(4)
    span = 60 * 24 * 6
    key = lambda: rng.choice((0, 0, 0, 1, 2, 3, None))
    left = [(key(), None if rng.random() < 0.05 else rng.randrange(-500, span), i) for i in range(400)]
    right = [(key(), None if rng.random() < 0.05 else rng.choice((rng.randrange(span), 777)), rng.randrange(50)) for i in range(150)]
    left += left[:5]
    a = spark.createDataFrame([(k, at(t), x) for k, t, x in left], "k long, ts timestamp_ntz, x long").repartition(4)
    b = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k long, seen timestamp_ntz, v long").repartition(3)
    out = asof_join(a, b, ["k"], "ts", "seen", ["v"], None if tolerance is None else timedelta(minutes=tolerance), bucket=bucket)
    assert out.columns == ["k", "ts", "x", "seen", "v"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(left, right, tolerance)


def test_ties_clashing_names_and_empty_tables(spark):
    a = spark.createDataFrame([(1, at(5), "old")], "k long, ts timestamp_ntz, v string")
    b = spark.createDataFrame([(1, at(5), "x", 1), (1, at(5), "a", 2)], "k long, ts2 timestamp_ntz, v string, version int")
    assert asof_join(a, b, ["k"], "ts", "ts2", ["v"], tie_break=["version"]).collect()[0].v == "a"
    assert asof_join(a, b, ["k"], "ts", "ts2", ["v"]).collect()[0].v == "x"
    assert asof_join(a, b.limit(0), ["k"], "ts", "ts2", ["v"]).collect()[0].v is None
    assert asof_join(a.limit(0), b, ["k"], "ts", "ts2", ["v"]).count() == 0


def test_a_key_is_sorted_bucket_by_bucket(spark):
    a = spark.range(1000).select(F.lit(1).alias("k"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id AS int)) AS ts"))
    plan = asof_join(a, a.withColumnsRenamed({"ts": "seen"}).withColumn("v", F.lit(1)), ["k"], "ts", "seen", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan.split("Window [last(__match", 1)[1].split("\n", 1)[0]
