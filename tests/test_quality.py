from datetime import date, datetime

import pytest

from panelcast.functions import scalars
from panelcast.operators import quality
from panelcast.sources import ingest

T = datetime(2024, 1, 10, 12)
SCHEMA = "pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, zone int, distance double, fare double, total double, file_month date"


def event(minutes=10.0, zone=10, distance=1.0, fare=5.0, total=5.0, pickup=T, month=date(2024, 1, 1)):
    from datetime import timedelta

    return (pickup, pickup + timedelta(minutes=minutes) if pickup and minutes is not None else None, zone, distance, fare, total, month)


CASES = [
    (event(), None),
    (event(pickup=None), "missing_timestamp"),
    (event(minutes=None), "missing_timestamp"),
    (event(month=date(2023, 12, 1)), "pickup_outside_file_month"),
    (event(month=date(2024, 2, 1), zone=264), "pickup_outside_file_month"),
    (event(pickup=datetime(2024, 2, 1), month=date(2024, 1, 1)), "pickup_outside_file_month"),
    (event(pickup=datetime(2024, 1, 1), month=date(2024, 1, 1)), None),
    (event(zone=None), "unknown_pickup_zone"),
    (event(zone=0), "unknown_pickup_zone"),
    (event(zone=264), "unknown_pickup_zone"),
    (event(zone=263), None),
    (event(minutes=0.5, distance=0.0), "impossible_duration"),
    (event(minutes=1), None),
    (event(minutes=240), None),
    (event(minutes=241), "impossible_duration"),
    (event(distance=0.0), "bad_distance"),
    (event(distance=100.0), None),
    (event(distance=None), "bad_distance"),
    (event(fare=0.0), None),
    (event(fare=1000.0), None),
    (event(fare=-1.0), "bad_fare"),
    (event(fare=None), "bad_fare"),
    (event(total=-0.01), "bad_fare"),
    (event(total=None), None),
]


@pytest.fixture(scope="module")
def tagged(spark):
    return quality.tag(spark.createDataFrame([c for c, _ in CASES], SCHEMA).repartition(1), quality.event_rules())


def test_each_row_gets_its_first_failing_rule(tagged):
    assert [r.drop_reason for r in tagged.collect()] == [want for _, want in CASES]


def test_audit_counts_every_row_once(tagged):
    rows = {r.reason: r.n for r in quality.audit(tagged).collect()}
    assert sum(rows.values()) == len(CASES) and rows["kept"] == sum(w is None for _, w in CASES)
    kept = quality.keep_valid(tagged)
    assert "drop_reason" not in kept.columns and kept.count() == rows["kept"]


def test_normalize_resolves_names_casts_and_fills_missing(spark):
    raw = spark.createDataFrame([("7", "x", 2.0)], "VendorId string, BAD string, Airport_FEE double")
    spec = {"vendor": ("int", ("vendorid",)), "code": ("int", ("none", "bad")), "fee": ("double", ("airport_fee",)), "gone": ("string", ("nowhere",))}
    out = ingest.normalize(raw, spec, {"year": 2024})
    assert out.first().asDict() == {"vendor": 7, "code": None, "fee": 2.0, "gone": None, "year": 2024}
    assert dict(out.dtypes)["gone"] == "string"


def test_files_with_different_schemas_become_one_table(spark, tmp_path):
    spark.range(2).selectExpr("id AS PULocationID", "cast(id AS int) AS fee").write.parquet(f"{tmp_path}/a")
    spark.range(3).selectExpr("cast(id AS double) AS pulocationid").write.parquet(f"{tmp_path}/b")
    out = ingest.read_normalized(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], {"zone": ("int", ("PULocationID",)), "fee": ("double", ("fee",))})
    assert out.count() == 5 and out.filter("fee IS NULL").count() == 3 and out.select("source_file").distinct().count() >= 2


def test_text_table_and_prefixed_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("DATE,REPORT_TYPE,V\n2024-01-01,FM,1\n")
    df = ingest.read_text_table(spark, [str(tmp_path / "x.csv")])
    assert set(dict(df.dtypes).values()) == {"string"} and ingest.column_like(df, "REPORT") == "REPORT_TYPE"


def test_completeness_needs_the_last_day_of_the_month(spark):
    rows = [("a", datetime(2024, 1, 31, 23, 51)), ("b", datetime(2024, 1, 12)), ("c", datetime(2024, 2, 29))]
    out = ingest.completeness(spark.createDataFrame(rows, "f string, ts timestamp_ntz"), "ts", ["f"])
    assert {r.f: r.complete for r in out.collect()} == {"a": True, "b": False, "c": True}


def test_months_with_lookback(spark):
    rows = [(r.year, r.month) for r in ingest.months(spark, date(2023, 12, 5), date(2024, 3, 1), 1).orderBy("year", "month").collect()]
    assert rows == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]


def test_holiday_rules(spark):
    days = {r.date for r in ingest.holidays(spark, 2024, 2024).collect()}
    assert {date(2024, 1, 1), date(2024, 1, 15), date(2024, 5, 27), date(2024, 11, 28), date(2024, 12, 25)} <= days and len(days) == 11


def test_a_repeated_dimension_key_fails(spark):
    with pytest.raises(Exception, match="key repeats"):
        ingest.unique_on(spark.createDataFrame([(1, "a"), (1, "b")], "key int, v string"), "key").collect()


def test_lenient_numbers(spark):
    rows = spark.createDataFrame([("81s",), ("T",), ("M",), ("*",), ("",), (None,), ("-1.50",), (" 3 ",), (".5",), ("1e",)], "x string")
    got = [(r.a, r.b) for r in rows.select(scalars.measure("x", 0.001).alias("a"), scalars.measure("x").alias("b")).collect()]
    assert got == [(81.0, 81.0), (0.001, None), (None, None), (None, None), (None, None), (None, None), (-1.5, -1.5), (3.0, 3.0), (None, None), (1.0, 1.0)]


def test_bounds_say_whether_a_limit_is_valid(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None,), (0.0,), (1.0,), (5.0,), (9.0,), (10.0,)], "v double")
    hit = lambda **k: [r.b for r in df.select(quality.Bound("r", F.col("v"), **k).broken().alias("b")).collect()]
    assert hit(low=0, high=10) == [True, False, False, False, False, False]
    assert hit(low=0, high=10, brackets="()") == [True, True, False, False, False, True]
    assert [bool(x) for x in hit(low=1, high=9, brackets="[)", required=False, banned=(5.0,))] == [False, True, False, True, True, True]


def test_months_and_times_out_of_parts_and_texts(spark):
    rows = spark.createDataFrame([(2024, 2, "2024-02-03T04:05:06"), (2024, 13, "x"), (None, 1, None)], "y int, m int, t string")
    got = [tuple(r) for r in rows.select(scalars.month_of("y", "m"), scalars.timestamp_of("t")).collect()]
    assert got == [(date(2024, 2, 1), datetime(2024, 2, 3, 4, 5, 6)), (None, None), (None, None)]


def test_observed_holidays_and_a_table_of_the_callers(spark):
    extra = spark.createDataFrame([(date(2021, 4, 19), "Patriots' Day"), (date(2021, 7, 4), "A later name")], "date date, holiday_name string")
    days = {r.date: r.holiday_name for r in ingest.holidays(spark, 2021, 2022, observed=True, extra=extra).collect()}
    assert days[date(2021, 7, 5)] == "Independence Day (observed)" and days[date(2021, 12, 24)] == "Christmas Day (observed)"
    assert days[date(2021, 12, 31)] == "New Year's Day (observed)" and days[date(2021, 4, 19)] == "Patriots' Day"
    assert days[date(2021, 7, 4)] == "A later name" and min(days).year == 2021 and max(days).year == 2022


REPORTS = [
    ("2024-01-10T00:51:00", "FM-15", "81s", "T", "60"),
    ("2024-01-10T00:51:00", "FM-15", "81s", "T", "60"),
    ("2024-07-10T00:51:00", " FM-15 ", "70", "0.10", "M"),
    ("2024-07-10T00:40:00", "FM-16", "99", "9", "1"),
    ("2024-11-03T00:51:00", "FM-15", "40", "0.2", "50"),
    ("2024-11-02T23:51:00", "FM-15", "50", "0.4", "*"),
    ("no time", "FM-15", "1", "1", "1"),
    (None, "FM-15", "1", "1", "1"),
]


def test_raw_reports_become_hours(spark):
    from panelcast.operators import observations

    raw = spark.createDataFrame(REPORTS, "DATE string, REPORT_TYPE5 string, Temp string, Rain string, Damp string")
    measures = {"temp": ("Temp", None), "rain": ("Rain", 0.001), "damp": ("Damp", None)}
    got = {r.hour_ts: (r.temp, r.rain, r.damp) for r in observations.clean_reports(raw, "FM-15", measures, ["rain"]).collect()}
    assert got == {datetime(2024, 1, 10, 1): (81.0, 0.001, 60.0), datetime(2024, 7, 10, 2): (70.0, 0.1, None), datetime(2024, 11, 3, 1): (45.0, 0.4, 50.0)}
