from datetime import datetime, timedelta

from panelcast.operators import panel
from panelcast.streaming import counts


def test_closed_hours_equal_the_batch_counts(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(h % 2, start + timedelta(hours=h, minutes=5 * k)) for h in range(10) for k in range(1 + h % 3)]
    df = spark.createDataFrame(rows, "key int, ts timestamp_ntz")
    df.write.parquet(f"{tmp_path}/in/0")
    spark.createDataFrame([(9, start + timedelta(hours=40))], df.schema).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = counts.feed(counts.hourly_counts(stream), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.key, str(r.hour_ts)[:19]): r.y for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.key, str(r.hour_ts)[:19]): r.y for r in panel.counts(df.selectExpr("key", "ts", "'x' AS category")).collect()}
    assert got == want
