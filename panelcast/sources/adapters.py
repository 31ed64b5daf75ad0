"""Views over the driver's tables in the shapes that the operators expect; all work grows with those tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.config import Splits

SPLITS = Splits(datetime(2024, 1, 1), datetime(2024, 1, 20), datetime(2024, 1, 25), datetime(2024, 1, 31))
CATEGORIES = {"y_click": "click", "y_view": "view"}

#: Column of the canonical event -> type and candidate source names.
EVENT_SPEC = {
    "vendor": ("int", ("VendorID", "l_suppkey")),
    "pickup_ts": ("timestamp_ntz", ("pickup_datetime", "Pickup_At")),
    "dropoff_ts": ("timestamp_ntz", ("dropoff_datetime", "DROPOFF_AT")),
    "zone": ("int", ("PULocationID", "pu_zone")),
    "distance": ("double", ("trip_distance",)),
    "fare": ("double", ("fare_amount",)),
    "total": ("double", ("total_amount",)),
    "airport_fee": ("double", ("Airport_fee",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drifted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw events under other names: some lack a pickup, some have a fare below zero or a wrong month."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    fare = F.col("l_extendedprice") / 100 * F.when(F.col("l_partkey") % 53 == 0, -1).otherwise(1)
    month = F.trunc("o_orderdate", "MM")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "L_SUPPKEY",
        F.when(F.col("l_partkey") % 97 != 0, F.col("o_orderdate")).alias("pickup_AT"),
        F.expr("o_orderdate + make_dt_interval(0, 0, cast((l_linenumber - 1) * l_quantity AS int), 0)").alias("dropoff_at"),
        (F.col("l_partkey") % 270).alias("PU_zone"),
        (2.1 * F.col("l_quantity") - 2.1).alias("Trip_Distance"),
        fare.alias("Fare_Amount"),
        (fare * (1 - F.col("l_discount"))).alias("Total_Amount"),
        F.when(F.col("l_orderkey") % 50 == 0, F.add_months(month, 1)).otherwise(month).alias("file_month"),
    )


def events(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """(key, ts, category) of the events table, keyed by user or by event type."""
    return table(spark, sf_dir, "events").select(F.col(key).alias("key"), "ts", F.col("event_type").alias("category"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, key_name, group_name): users of the events table with their customer's name and region."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct()
    return users.join(people, F.col("key") == F.col("c_custkey")).select("key", F.col("c_name").alias("key_name"), F.col("r_name").alias("group_name"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messy observation text: missing `M`, trace `T`, suspect suffix `s`."""
    n, value = F.col("event_id"), F.col("value").cast("decimal(10,2)").cast("string")
    text = F.when(n % 17 == 0, "M").when(n % 13 == 0, "T").when(n % 11 == 0, F.concat(value, F.lit("s"))).otherwise(value)
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("report_type"), F.col("ts").alias("obs_ts"), text.alias("amount"), F.concat(F.lit(" "), text).alias("level"))


def standard_time_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports in standard time, each at two consecutive hours."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return rows.select("o_orderkey", "o_totalprice", F.expr("cast(o_orderdate AS timestamp_ntz) + make_dt_interval(0, cast(o_orderkey % 24 AS int) + k, 51, 0)").alias("obs_ts"))
