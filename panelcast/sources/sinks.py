"""Table sinks: append, overwrite, replacement of one slice, compact export."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shared forecast table; a column that a model does not give is null in the type named here.
FORECAST_COLUMNS = {"model": "string", "key": "string", "hour_ts": "timestamp_ntz", "y": "int", "prediction": "double", "p10": "double", "p90": "double"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors share spark.checkpoint.dir; where that is unset, on one machine only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='spark-panel-')).rstrip('/')}/{uuid.uuid4().hex}"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a table, its schema included."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def replace_slice(df: DataFrame, path: str, by: str, within: tuple[str, ...] = ()) -> None:
    """Replace the partitions of `by` that df has rows for and leave the others: writing twice changes nothing.

    Rows are dealt out by ranges of `by` and the columns `within`, so that a large
    slice is written by several tasks. df must not read from path: a slice is
    deleted before its rows are moved in.
    """
    dealt = df.repartitionByRange(by, *within) if within else df.repartition(F.col(by))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def delete_slice(spark: SparkSession, path: str, by: str, value: object) -> bool:
    """Drop one partition of a table that replace_slice wrote; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forecast_rows(scored: DataFrame, model: str) -> DataFrame:
    """Rows of the shared forecast table; a model without a band has null p10 and p90."""
    given = {c: F.col(c) for c in scored.columns} | {"model": F.lit(model)}
    return scored.select([given.get(name, F.lit(None).cast(kind)).alias(name) for name, kind in FORECAST_COLUMNS.items()])


def compact(forecasts: DataFrame) -> DataFrame:
    """Narrow types for an export; p10 is rounded up and p90 down to a tenth, so what the band covers stays so."""
    tenth = lambda f, c: (f(F.col(c) * 10) / 10).cast("float").alias(c)
    return forecasts.select("model", "key", "hour_ts", F.col("y").try_cast("smallint").alias("y"), tenth(F.round, "prediction"), tenth(F.ceil, "p10"), tenth(F.floor, "p90"))


def export(forecasts: DataFrame, path: str) -> None:
    compact(forecasts).repartitionByRange("model", "hour_ts", "key").sortWithinPartitions("model", "hour_ts", "key").write.mode("overwrite").option("compression", "zstd").parquet(path)
