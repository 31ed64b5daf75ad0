import os
import uuid
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from panelcast.sources import ingest

SPEC = {"zone": ("int", ("PULocationID",)), "fee": ("double", ("airport_fee",)), "at": ("timestamp_ntz", ("pickup_at", "Pickup_AT"))}
TIME = datetime(2024, 1, 1, 5)


def jobs_of(spark, work):
    """What `work` returns, and how many Spark jobs it ran."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    out = work()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def many_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    kinds = [
        pa.table({"PULocationID": pa.array([1.0, None]), "Airport_Fee": pa.array([0.5, 1.5]), "pickup_at": pa.array([TIME, None], pa.timestamp("us"))}),
        pa.table({"pulocationid": pa.array([2, 3], pa.int64())}),
        pa.table({"PULocationID": pa.array([4, 70_000], pa.uint32()), "airport_fee": pa.array(["2", "none"]), "extra": pa.array([b"x", None])}),
    ]
    paths = []
    for k in range(2000):
        path = f"{folder}/f{k:04d}.parquet"
        pq.write_table(kinds[k % 3], path)
        paths.append(path)
    return paths


def test_two_thousand_files_of_three_schemas_take_few_jobs(spark, many_files):
    df, jobs = jobs_of(spark, lambda: ingest.read_normalized(spark, many_files, SPEC))
    assert jobs <= 3
    rows = df.collect()
    assert len(rows) == 4000 and len({r.source_file for r in rows}) == 2000
    got = {(r.zone, r.fee, r["at"]) for r in rows}
    assert got == {(1, 0.5, TIME), (None, 1.5, None), (2, None, None), (3, None, None), (4, 2.0, None), (70_000, None, None)}
    assert len(ingest.file_schemas(spark, many_files)) == 3


def test_folders_and_hidden_files(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    spark.range(10).selectExpr("id AS PULocationID", "id % 2 AS part").write.partitionBy("part").parquet(path)
    pq.write_table(pa.table({"PULocationID": ["9"]}), f"{tmp_path}/_hidden.parquet")
    (tmp_path / "table" / "_tmp").mkdir()
    pq.write_table(pa.table({"PULocationID": ["9"]}), f"{tmp_path}/table/_tmp/x.parquet")
    for form in (path, f"{tmp_path}/table", f"file:{tmp_path}/table"):
        rows = ingest.read_normalized(spark, [form], {"zone": ("int", ("pulocationID",))}).collect()
        assert sorted(r.zone for r in rows) == list(range(10))


def test_a_store_that_only_spark_opens(spark, tmp_path):
    pq.write_table(pa.table({"PULocationID": [7]}), f"{tmp_path}/a.parquet")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shop.link./in", f"file://{tmp_path}")
    rows = ingest.read_normalized(spark, ["viewfs://shop/in/a.parquet", f"{tmp_path}/a.parquet"], {"zone": ("int", ("PULocationID",))}).collect()
    assert [r.zone for r in rows] == [7, 7]


def test_no_file_and_no_folder(spark, tmp_path):
    os.makedirs(f"{tmp_path}/empty")
    with pytest.raises(ValueError, match="no Parquet files"):
        ingest.read_normalized(spark, [f"{tmp_path}/empty"], SPEC)
    with pytest.raises(Exception, match="nowhere"):
        ingest.read_normalized(spark, [f"{tmp_path}/nowhere.parquet"], SPEC)


def test_types_as_spark_reads_them(spark, tmp_path):
    table = pa.table({"d": pa.array([1], pa.decimal128(9, 2)), "c": pa.array(["x"]).dictionary_encode(), "l": pa.array([[1]]), "n": pa.array([TIME], pa.timestamp("us")), "z": pa.array([TIME], pa.timestamp("us", "UTC"))})
    pq.write_table(table, f"{tmp_path}/a.parquet")
    pq.write_table(pa.table({"n": pa.array([TIME], pa.timestamp("us"))}), f"{tmp_path}/b.parquet", use_deprecated_int96_timestamps=True)
    for name in "ab":
        (schema, _), = ingest.file_schemas(spark, [f"{tmp_path}/{name}.parquet"])
        assert schema.simpleString() == spark.read.parquet(f"{tmp_path}/{name}.parquet").schema.simpleString()
        assert spark.read.schema(schema).parquet(f"{tmp_path}/{name}.parquet").count() == 1
