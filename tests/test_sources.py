"""Monthly files, file jobs and quality checks."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.operators import enrich, quality
from stepchange.sources import files, monthly

CFG = StudyConfig()


@pytest.fixture
def drifting(spark, tmp_path):
    old = spark.sql(
        "select 'HV1' as HVFHS_LICENSE_NUM, cast(7 as bigint) as pulocationid, "
        "cast(8 as bigint) as DOLocationID, timestamp_ntz'2024-01-05 10:00:00' as pickup_datetime, "
        "cast(3.5 as float) as trip_miles, 9 as extra"
    )
    new = spark.sql(
        "select 'HV1' as hvfhs_license_num, 7 as PULocationID, 8 as DOLocationID, "
        "timestamp_ntz'2025-01-05 10:00:00' as pickup_datetime, 3.5D as trip_miles, "
        "1.5D as cbd_congestion_fee"
    )
    paths = {date(2024, 1, 1): str(tmp_path / "a.parquet"), date(2025, 1, 1): str(tmp_path / "b.parquet")}
    for data, path in zip((old, new), paths.values()):
        data.write.parquet(path)
    return paths


def test_drifting_months_get_one_schema(spark, drifting):
    data = monthly.read_months(spark, drifting, CFG)
    assert dict(data.dtypes) == {**CFG.columns, "file_month": "date"}
    rows = data.orderBy("file_month").collect()
    assert [r.cbd_congestion_fee for r in rows] == [None, 1.5]
    assert [r.file_month for r in rows] == list(drifting)
    assert {(r.PULocationID, r.trip_miles, r.driver_pay) for r in rows} == {(7, 3.5, None)}


def test_month_filter_prunes_whole_files(spark, drifting):
    data = monthly.read_months(spark, drifting, CFG).where(F.year("file_month") == 2025)
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_month_list_crosses_years():
    months = monthly.month_starts(date(2023, 11, 1), date(2024, 2, 1))
    assert months == [date(2023, 11, 1), date(2023, 12, 1), date(2024, 1, 1), date(2024, 2, 1)]


def test_incremental_build_makes_only_missing_months(spark, tmp_path):
    path, built = str(tmp_path / "facts"), []

    def build(months):
        built.append(months)
        return spark.createDataFrame([(m, m.month) for m in months], "file_month date, n int")

    first, second = date(2024, 1, 1), date(2024, 2, 1)
    files.build_missing_months(spark, path, [first], build)
    table = files.build_missing_months(spark, path, [first, second], build)
    assert built == [[first], [second]]
    assert sorted((r.file_month, r.n) for r in table.collect()) == [(first, 1), (second, 2)]
    files.build_missing_months(spark, path, [first], build, overwrite=True)
    assert built[-1] == [first]
    assert spark.read.parquet(path).count() == 2


def test_a_large_month_is_written_by_several_tasks(spark, tmp_path):
    month, size = date(2024, 1, 1), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "16k")
    try:
        table = files.build_missing_months(spark, str(tmp_path / "facts"), [month], lambda months: spark.range(0, 40_000, 1, 8).select(F.lit(months[0]).alias("file_month"), "id"))
        assert table.select("_metadata.file_name").distinct().count() > 1
        assert table.agg(F.count("id"), F.sum("id")).first() == (40_000, 40_000 * 39_999 // 2)
    finally:
        spark.conf.set(size, before)


def test_recompact_keeps_rows_and_schema(spark, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    spark.range(1000).withColumn("x", F.col("id") * 2).coalesce(1).write.parquet(source)
    written = files.recompact(spark, source, target, rows_per_file=300)
    assert written.count() == 1000
    assert written.select("_metadata.file_name").distinct().count() == 4


def test_recompact_leaves_files_with_small_row_groups_alone(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "target"
    wide = [F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256).alias(f"c{k}") for k in range(20)]
    spark.range(4000).select("id", *wide).coalesce(1).write.parquet(str(source))
    spark.range(4000, 4100).select("id", *wide).coalesce(1).write.mode("append").parquet(str(source))
    before = {p.name: p.read_bytes() for p in source.glob("*.parquet")}
    large = {r.path.split("/")[-1] for r in files.footers(spark, [str(source)]).where("largest_group > 2e6").collect()}
    assert len(large) == 1 and len(before) == 2
    found = files.recompact(spark, str(source), str(target), rows_per_file=1000, max_group_mb=2)
    assert found.exceptAll(spark.read.parquet(str(source))).count() == 0 and found.count() == 4100
    names = {r[0] for r in found.select("_metadata.file_name").distinct().collect()}
    assert names & set(before) == set(before) - large and len(names) == 5
    assert {p.name: p.read_bytes() for p in source.glob("*.parquet")} == before
    assert files.footers(spark, found.inputFiles()).where("largest_group > 2e6").count() == 0
    again = files.recompact(spark, str(source), str(tmp_path / "none"), max_group_mb=1000)
    assert {r[0] for r in again.select("_metadata.file_name").distinct().collect()} == set(before)


def test_many_files_are_profiled_in_one_scan(spark, tmp_path):
    spark.range(300).repartition(60).write.parquet(str(tmp_path / "many"))
    profile = files.file_profile(spark, [str(tmp_path / "many")])
    assert profile.count() == 60 and profile.agg(F.sum("rows")).first()[0] == 300
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Union" not in plan and "FileScan" not in plan


def test_a_folder_of_parts_is_profiled_as_one_table(spark, tmp_path):
    spark.range(300).repartition(7).write.parquet(str(tmp_path / "trips_1.parquet"))
    spark.range(5).selectExpr("id", "id as b").coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    found = files.table_profile(spark, [str(tmp_path / "trips_1.parquet"), str(tmp_path / "one.parquet") + "/"])
    rows = sorted((r.file, r.service, r.rows, r.columns) for r in found.collect())
    assert rows == [("one.parquet", "one", 5, 2), ("trips_1.parquet", "trips", 300, 1)]


def test_file_profile_query_has_one_row_for_a_table_of_parts(spark, tmp_path):
    from stepchange.plans import catalog

    for name, width in catalog.FILES.items():
        wide = spark.range(20).select(*[F.col("id").alias(f"c{i}") for i in range(width)])
        wide.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = {(r.file, r.service, r.rows, r["columns"]) for r in catalog.file_profile(spark, str(tmp_path)).collect()}
    assert rows == {(f"{name}.parquet", name, 20, width) for name, width in catalog.FILES.items()}


def test_a_lost_writer_leaves_the_published_version(spark, tmp_path):
    path = str(tmp_path / "table")
    assert files.published(spark, path) is None
    first = files.publish(spark.range(3), path)

    def broken():
        return spark.range(4).select(F.raise_error(F.lit("lost")).alias("x"))

    with pytest.raises(Exception, match="lost"):
        files.load_or_build(spark, path, ["x"], broken)
    assert files.published(spark, path).count() == 3
    second = files.load_or_build(spark, path, ["id", "x"], lambda: spark.range(5).select("id", F.lit(1).alias("x")))
    # The new version is found by the next call; a reader of the first one still has it
    assert second.count() == 5 and first.count() == 3
    assert files.load_or_build(spark, path, ["x"], broken).count() == 5


def test_reconcile_raises_on_a_short_extract(spark):
    files.reconcile(spark.range(5), 5, "extract")
    with pytest.raises(ValueError, match="5 rows, but 6"):
        files.reconcile(spark.range(5), 6, "extract")


def test_load_or_build_rebuilds_without_a_required_column(spark, tmp_path):
    path, calls = str(tmp_path / "labels"), []

    def build(columns):
        def make():
            calls.append(columns)
            return spark.range(3).select(*[F.col("id").alias(c) for c in columns])

        return make

    files.load_or_build(spark, path, ["a"], build(["a"]))
    files.load_or_build(spark, path, ["a"], build(["a"]))
    again = files.load_or_build(spark, path, ["a", "b"], build(["a", "b"]))
    assert calls == [["a"], ["a", "b"]] and again.columns == ["a", "b"]


def test_csv_sink_has_a_header(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_csv(spark.range(3).toDF("zone"), path)
    back = spark.read.csv(path, header=True, schema="zone long")
    assert sorted(r.zone for r in back.collect()) == [0, 1, 2]


def test_file_profile_and_column_range(spark, tmp_path):
    for name, width in (("fhvhv_1", 2), ("fhvhv_2", 3)):
        data = spark.range(10).select(*[F.col("id").alias(f"c{i}") for i in range(width)])
        data.coalesce(1).write.parquet(str(tmp_path / name))
    profile = files.file_profile(spark, [str(tmp_path / "fhvhv_1"), str(tmp_path / "fhvhv_2")])
    assert sorted((r.rows, r.columns) for r in profile.collect()) == [(10, 2), (10, 3)]
    ranges = files.column_range(profile.withColumn("service", F.lit("fhvhv"))).collect()
    assert [(r.service, r.columns) for r in ranges] == [("fhvhv", "2-3")]


def test_station_file(spark, tmp_path):
    path = tmp_path / "station.csv"
    path.write_text(
        "STATION,DATE,PRCP,SNOW,SNWD,TMAX,TMIN\nS,2024-01-02,1.5,,,3.0,-1.0\nS,2024-01-01,0.0,2.0,5.0,1.0,-2.0\n"
    )
    weather = enrich.daily_covariates(enrich.read_station(spark, str(path)), CFG)
    rows = weather.orderBy("date").collect()
    assert [r.snow_mm for r in rows] == [2.0, 0.0] and rows[1].snow_depth_mm == 0.0


@pytest.mark.parametrize("text", ["S,2024-01-01,,1,1,1,1", "S,2024-01-02,1,1,1,1,1"])
def test_station_file_with_a_gap_or_a_repeat_is_refused(spark, tmp_path, text):
    path = tmp_path / "station.csv"
    path.write_text(f"STATION,DATE,PRCP,SNOW,SNWD,TMAX,TMIN\nS,2024-01-02,1,1,1,1,1\n{text}\n")
    with pytest.raises(quality.DataQualityError):
        enrich.daily_covariates(enrich.read_station(spark, str(path)), CFG)


def test_holidays_and_flag(spark):
    cfg = replace(CFG, holidays=(date(2024, 7, 4),))
    days = spark.createDataFrame([(date(2024, 7, 4),), (date(2024, 7, 5),)], "date date")
    assert [r.is_holiday for r in enrich.add_holidays(days, cfg).orderBy("date").collect()] == [True, False]
    assert enrich.add_holidays(days, CFG).first().is_holiday
    assert not enrich.add_holidays(days, replace(CFG, holidays=())).first().is_holiday


def test_checks(spark):
    data = spark.createDataFrame([(1, "a", True), (1, None, True), (2, "a", False)], "k int, n string, f boolean")
    assert [(r.k, r.rows) for r in quality.duplicate_keys(data, ["k"]).collect()] == [(1, 2)]
    assert {r["column"]: r.nulls for r in quality.null_violations(data, ["k", "n"]).collect()} == {"k": 0, "n": 1}
    assert quality.flag_cardinality(data, "f", 2).first().ok
    with pytest.raises(quality.DataQualityError, match="n \\(1\\)"):
        quality.require_complete(data, ["k", "n"], "table")
    named = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "LocationID int, Zone string")
    assert sorted(r.LocationID for r in quality.shared_names(named).collect()) == [1, 2]
