"""Scans with drifting schemas, file checks, dimensions and holidays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date
from functools import reduce
from multiprocessing.pool import ThreadPool

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import PySparkTypeError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import DecimalType, IntegerType, LongType, ShortType, StructField, StructType, TimestampType

Spec = dict[str, tuple[str, tuple[str, ...]]]


def normalize(df: DataFrame, spec: Spec, lineage: dict[str, Column | object] | None = None) -> DataFrame:
    """Columns of `spec` (name -> type, candidate source names), found whatever their case.

    The first candidate that exists is taken; a value that does not fit the type
    and a missing column become null. Lineage columns are added at the end.
    """
    have = {c.lower(): c for c in df.columns}

    def pick(name: str, kind: str, candidates: tuple[str, ...]) -> Column:
        source = next((have[c.lower()] for c in candidates if c.lower() in have), None)
        value = F.lit(None).cast(kind) if source is None else F.col(f"`{source}`").try_cast(kind)
        return value.alias(name)

    extra = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in (lineage or {}).items()]
    return df.select(*[pick(n, t, c) for n, (t, c) in spec.items()], *extra)


#: Files that the driver lists by itself for a scan; for more, Spark runs a listing job for each distinct schema.
LISTED = 4096
#: Paths at a time whose schemas Spark's own reader is asked for, where workers cannot open the store.
ASKED = 16


def file_schemas(spark: SparkSession, paths: list[str]) -> list[tuple[StructType, list[str]]]:
    """(schema, files) of Parquet files and folders of them, one entry for each distinct schema; files that lie in stores that workers cannot open are asked for by path.

    Workers list the folders and read the footers, one job for all of them; each
    task tells a schema once, with its files. Columns of types that Spark has
    not are left out.
    """
    if not paths:
        raise ValueError("no paths")
    found = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string").mapInArrow(_footers, "schema string, files array<string>").collect()
    groups: dict[str, list[str]] = {}
    for row in found:
        groups.setdefault(row["schema"], []).extend(row["files"])
    closed = sorted(groups.pop("", []))
    out = [(StructType.fromJson(json.loads(k)), sorted(v)) for k, v in sorted(groups.items())]
    if closed:
        with ThreadPool(min(ASKED, len(closed))) as pool:
            schemas = pool.map(lambda path: spark.read.parquet(path).schema, closed)
        same: dict[str, list[str]] = {}
        for path, schema in zip(closed, schemas, strict=True):
            same.setdefault(schema.json(), []).append(path)
        out += [(StructType.fromJson(json.loads(k)), v) for k, v in sorted(same.items())]
    if not out:
        raise ValueError(f"no Parquet files in {paths[0]}" + " ..." * (len(paths) > 1))
    return out


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct schemas of the files of some paths; "" where the path's file system is not known here."""
    groups: dict[str, list[str]] = {}
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                store, inner = fs.FileSystem.from_uri(path)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                groups.setdefault("", []).append(path)
                continue
            path = path.rstrip("/")
            before = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            for file in _data_files(store, inner):
                with store.open_input_file(file) as f:
                    groups.setdefault(_spark_schema(pq.ParquetFile(f)).json(), []).append(f"{before}{file}")
    yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(groups.values(), pa.list_(pa.string()))], ["schema", "files"])


def _data_files(store: fs.FileSystem, path: str) -> list[str]:
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    hidden = re.compile(r"(^|/)[_.]")
    inside = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(x.path for x in inside if x.type == fs.FileType.File and not hidden.search(x.path[len(path) :].lstrip("/")))


#: Spark's types of unsigned numbers.
UNSIGNED = {pa.uint8(): ShortType(), pa.uint16(): IntegerType(), pa.uint32(): LongType(), pa.uint64(): DecimalType(20, 0)}


def _spark_schema(file: pq.ParquetFile) -> StructType:
    """The schema that Spark reads a file with. Old 96-bit times have a time zone, times without one have none."""
    old = {file.schema.column(i).path for i in range(len(file.schema)) if file.schema.column(i).physical_type == "INT96"}
    out = []
    for field in file.schema_arrow:
        kind = field.type.value_type if pa.types.is_dictionary(field.type) else field.type
        try:
            known = TimestampType() if field.name in old else UNSIGNED.get(kind) or from_arrow_type(kind, prefer_timestamp_ntz=True)
        except PySparkTypeError:
            continue
        out.append(StructField(field.name, known))
    return StructType(out)


def read_normalized(spark: SparkSession, paths: list[str], spec: Spec) -> DataFrame:
    """Parquet files whose schemas differ, as one plan: one scan for each distinct schema, then a union by name.

    Schemas are read by workers before (`file_schemas`); the driver gets distinct
    ones alone, so the number of jobs does not grow with the files. `source_file`
    is each row's file.
    """
    schemas = file_schemas(spark, paths)
    option = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before = spark.conf.get(option, None)
    try:
        spark.conf.set(option, str(max(LISTED, int(before or 0))))
        parts = [normalize(spark.read.schema(schema).parquet(*files), spec, {"source_file": F.col("_metadata.file_path")}) for schema, files in schemas]
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)
    return reduce(DataFrame.unionByName, parts)


def read_text_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV with a header; every column stays a string."""
    return spark.read.option("header", True).csv(paths)


def column_like(df: DataFrame, prefix: str) -> str:
    """The first column with the prefix; readers rename repeated headers."""
    return next(c for c in df.columns if c.startswith(prefix))


def dimension(df: DataFrame, spec: Spec, key: str, drop: tuple = ()) -> DataFrame:
    """A dimension table with one row a key: normalized, pseudo keys dropped. Raises later if a key repeats."""
    rows = normalize(df, spec).filter(~F.col(key).isin(*drop)) if drop else normalize(df, spec)
    return unique_on(rows, key)


def unique_on(df: DataFrame, *keys: str) -> DataFrame:
    """df, failing at run time when a key repeats: a repeated dimension row would silently multiply a panel."""
    first = [F.first(c).alias(c) for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("__n"), *first)
    checked = F.when(F.col("__n") == 1, F.col(keys[0])).otherwise(F.raise_error(F.lit(f"{', '.join(keys)} repeats")).cast(df.schema[keys[0]].dataType))
    return grouped.withColumn(keys[0], checked).select(*df.columns)


def months(spark: SparkSession, start: date, end: date, lookback: int = 0) -> DataFrame:
    """(year, month) of each month in [start, end), with `lookback` months before them."""
    last = f"date'{end}' - INTERVAL 1 DAY"
    first = f"add_months(trunc(date'{start}', 'MM'), {-lookback})"
    days = spark.range(1).select(F.explode(F.expr(f"sequence({first}, {last}, INTERVAL 1 MONTH)")).alias("d"))
    return days.select(F.year("d").alias("year"), F.month("d").alias("month"))


def completeness(df: DataFrame, ts: str, by: list[Column | str]) -> DataFrame:
    """Per source file (or `by`): rows, first and last day, and whether the last is its month's last day."""
    day = F.to_date(ts)
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")).withColumn("complete", F.col("last_day") == F.last_day("last_day"))


#: Fixed values: (month, weekday 0 is Monday, which one or -1 for the last, name) and (month, day, name).
MOVING = ((1, 0, 3, "Martin Luther King Jr. Day"), (2, 0, 3, "Washington's Birthday"), (5, 0, -1, "Memorial Day"), (9, 0, 1, "Labor Day"), (10, 0, 2, "Columbus Day"), (11, 3, 4, "Thanksgiving Day"))
FIXED = ((1, 1, "New Year's Day"), (6, 19, "Juneteenth National Independence Day"), (7, 4, "Independence Day"), (11, 11, "Veterans Day"), (12, 25, "Christmas Day"))


def holidays(spark: SparkSession, first_year: int, last_year: int, observed: bool = False, extra: DataFrame | None = None) -> DataFrame:
    """(date, holiday_name) by rules; with `observed`, the weekday on which a fixed day at a weekend is kept too.

    A fixed day on a Saturday is kept on the Friday before, on a Sunday on the
    Monday after. `extra` is a table of the caller's, such as state days; of
    several names of a date the first in order stays.
    """
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first_year - 1}-12-01', date'{last_year + 1}-01-31', INTERVAL 1 DAY)")).alias("date"))
    month, day, weekday = F.month("date"), F.dayofmonth("date"), F.weekday("date")
    fixed = F.coalesce(*[F.when((month == m) & (day == d), F.lit(n)) for m, d, n in FIXED])
    nth = F.ceil(day / 7)
    last = day > F.dayofmonth(F.last_day("date")) - 7
    moving = F.coalesce(*[F.when((month == m) & (weekday == w) & (last if k < 0 else nth == k), F.lit(n)) for m, w, k, n in MOVING])
    found = days.select("date", F.coalesce(fixed, moving).alias("holiday_name"))
    if observed:
        shift = F.when(weekday == 5, -1).when(weekday == 6, 1)
        moved = days.filter(shift.isNotNull()).select(F.date_add("date", shift).alias("date"), F.concat(fixed, F.lit(" (observed)")).alias("holiday_name"))
        found = found.unionByName(moved)
    if extra is not None:
        found = found.unionByName(extra.select("date", "holiday_name"))
    named = found.filter("holiday_name IS NOT NULL").filter((F.year("date") >= first_year) & (F.year("date") <= last_year))
    return named.groupBy("date").agg(F.min("holiday_name").alias("holiday_name"))
