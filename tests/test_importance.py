import pytest
from pyspark.sql import functions as F

from panelcast.operators import importance


def test_numbers_and_permutations(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS k", "id AS v").repartition(7)
    rows, n = importance.numbered(df, "k")
    assert n == 1000 and sorted((r.k, r[importance.NUMBER]) for r in rows.collect()) == [(i, i) for i in range(1000)]
    a, b = importance.stride(n, 3)
    for seed in (3, 4):
        out = importance.permuted(rows, n, ["v"], seed).collect()
        assert sorted(r.v for r in out) == list(range(1000)) and len({r.k for r in out}) == 1000
    value = {r[importance.NUMBER]: r.v for r in rows.collect()}
    assert all(r.v == value[(a * r[importance.NUMBER] + b) % n] for r in importance.permuted(rows, n, ["v"], 3).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 1024, 30030])
def test_strides_deal_all_rows(n):
    for seed in range(5):
        a, b = importance.stride(n, seed)
        assert len({(a * i + b) % n for i in range(n)}) == n


def test_losses_rise_with_what_matters(spark):
    df = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 50).cast("double").alias("past"), (F.col("id") % 7).cast("double").alias("future"), F.lit(1.0).alias("static"))
    df = df.withColumn("y", 3 * F.col("past") + F.col("future"))
    rows, n = importance.numbered(df, "key")
    predict = lambda d: d.withColumn("prediction", 3 * F.col("past") + F.col("future") + 0 * F.col("static"))
    got = {r.group: (r.loss, r.increase) for r in importance.permutation_losses(rows, n, {g: [g] for g in ("past", "future", "static")}, predict).collect()}
    assert got["none"] == (0.0, 0.0) and got["static"] == (0.0, 0.0) and got["past"][1] > 3 * got["future"][1] > 0


def test_no_rows(spark):
    rows, n = importance.numbered(spark.range(0).withColumn("y", F.lit(1.0)), "id")
    assert n == 0 and importance.permuted(rows, n, ["y"]).count() == 0
