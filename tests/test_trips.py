"""Durations, rules, attribution and analysis columns on hand-built rows."""

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.functions import columns as C
from stepchange.operators import trips

CFG = replace(StudyConfig(), seed_zones=(1, 2))
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in CFG.columns.items()) + ", file_month date"
PICKUP = datetime(2025, 3, 12, 10, 0)


def trip(**changes):
    row = {
        CFG.vendor: "V",
        CFG.request: datetime(2025, 3, 12, 9, 55),
        CFG.pickup: PICKUP,
        CFG.dropoff: datetime(2025, 3, 12, 10, 30),
        CFG.origin: 1,
        CFG.destination: 3,
        CFG.distance: 5.0,
        CFG.fee: 1.5,
        CFG.pay: 20.0,
        CFG.shared: "N",
        "file_month": date(2025, 3, 1),
    }
    row.update(changes)
    return tuple(row.values())


def frame(spark, rows):
    return trips.add_trip_time(spark.createDataFrame(rows, SCHEMA), CFG)


LABELS = [
    (1, "A", "cbd", "cbd"),
    (2, "B", "cbd", "cbd"),
    (3, "C", "ring", "ring_adjacent"),
    (4, "D", "ring", "ring_across"),
    (5, "E", "control", "control_near"),
    (6, "F", "control", "control_far"),
    (264, "U", None, None),
    (265, "V", None, None),
]


def labels(spark):
    return spark.createDataFrame(
        LABELS, "LocationID int, Zone string, zone_group string, zone_group_fine string"
    )


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_durations_are_real_instants_in_any_session_zone(spark, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        rows = [
            trip(**{CFG.pickup: datetime(2024, 3, 10, 1, 30), CFG.dropoff: datetime(2024, 3, 10, 3, 30)}),
            trip(**{CFG.pickup: datetime(2024, 11, 3, 0, 30), CFG.dropoff: datetime(2024, 11, 3, 2, 30)}),
            trip(**{CFG.pickup: datetime(2024, 6, 1, 1, 0), CFG.dropoff: datetime(2024, 6, 1, 2, 0)}),
        ]
        found = [r.trip_seconds for r in frame(spark, rows).orderBy(CFG.pickup).collect()]
        assert found == [3600, 3600, 10800]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_zero_length_trip_has_null_speed_and_is_removed(spark):
    rows = frame(spark, [trip(**{CFG.dropoff: PICKUP})])
    assert rows.first().speed_mph is None
    assert trips.clean(rows, CFG).count() == 0


FAILING = {
    "pickup_in_file_month": {"file_month": date(2025, 2, 1)},
    "dropoff_after_pickup": {CFG.dropoff: PICKUP},
    "positive_driver_pay": {CFG.pay: 0.0},
    "trip_length": {CFG.dropoff: datetime(2025, 3, 12, 15, 0, 1)},
    "distance_cap": {CFG.distance: 100.5, CFG.dropoff: datetime(2025, 3, 12, 15, 0)},
    "speed_cap": {CFG.distance: 31.0},
    "money_cap": {CFG.pay: 500.01},
    "known_zones": {CFG.origin: 264},
}


@pytest.mark.parametrize("rule", FAILING)
def test_each_rule_removes_its_row(spark, rule):
    rows = frame(spark, [trip(**FAILING[rule]), trip()])
    failed = [r[0] for r in rows.select(trips.first_failed_rule(CFG)).collect()]
    assert failed == [rule, "kept"]
    assert trips.clean(rows, CFG).count() == 1


def test_rows_on_a_cut_off_are_kept(spark):
    rows = [
        trip(**{CFG.dropoff: datetime(2025, 3, 12, 10, 1), CFG.distance: 1.0}),
        trip(**{CFG.dropoff: datetime(2025, 3, 12, 15, 0), CFG.distance: 100.0}),
        trip(**{CFG.pay: 500.0}),
        trip(**{CFG.distance: 30.0}),
        trip(**{CFG.distance: 0.0}),
    ]
    assert trips.clean(frame(spark, rows), CFG).count() == len(rows)


def test_nulls_are_removed_and_first_rule_takes_the_blame(spark):
    rows = frame(
        spark,
        [
            trip(**{CFG.pay: None}),
            trip(**{CFG.distance: None}),
            trip(**{CFG.pay: -1.0, "file_month": date(2025, 1, 1)}),
        ],
    )
    failed = [r[0] for r in rows.select(trips.first_failed_rule(CFG)).collect()]
    assert failed == ["positive_driver_pay", "distance_cap", "pickup_in_file_month"]


def test_funnel_counts_match_cleaning(spark):
    rows = frame(spark, [trip()] * 3 + [trip(**change) for change in FAILING.values()])
    funnel = {r.step: r for r in trips.cleaning_funnel(rows, CFG, "24-25").collect()}
    assert funnel["raw"].rows == 11 and funnel["raw"].columns == "24-25"
    assert funnel["keep_columns"].removed == 0
    assert [funnel[name].removed for name in FAILING] == [1] * 8
    assert funnel["known_zones"].rows == trips.clean(rows, CFG).count() == 3
    assert funnel["known_zones"].removed_pct == round(100 / 11, 3)


def test_funnel_of_an_empty_table(spark):
    funnel = trips.cleaning_funnel(frame(spark, []), CFG, 10).collect()
    assert {r.rows for r in funnel} == {0} and len(funnel) == 10


@pytest.mark.parametrize(
    "ends, kept",
    [((264, 1), True), ((1, 265), True), ((264, 3), False), ((5, 265), False), ((264, 265), False)],
)
def test_unknown_end_is_kept_only_opposite_the_seed_area(spark, ends, kept):
    rows = frame(spark, [trip(**{CFG.origin: ends[0], CFG.destination: ends[1]})])
    assert (trips.clean(rows, CFG).count() == 1) is kept


@pytest.mark.parametrize(
    "shared, distance, earnings, hourly",
    [
        ("N", 1.0, 20.0, 40.0),
        ("Y", 1.0, 20.0, None),
        (None, 1.0, 20.0, None),
        ("N", 0.0, None, None),
        ("Y", 0.0, None, None),
        (None, 0.0, None, None),
    ],
)
def test_earnings_truth_table(spark, shared, distance, earnings, hourly):
    rows = frame(spark, [trip(**{CFG.shared: shared, CFG.distance: distance})])
    row = trips.add_columns(rows, labels(spark), CFG).first()
    assert (row.earnings, row.earnings_per_engaged_hour) == (earnings, hourly)


def test_trip_group_of_every_pair_of_zones(spark):
    order = ["cbd", "ring_adjacent", "ring_across", "control_near", "control_far", "unknown"]
    fine = {zone: group or "unknown" for zone, _, _, group in LABELS}
    pairs = [(a, b) for a in fine for b in fine]
    rows = frame(spark, [trip(**{CFG.origin: a, CFG.destination: b}) for a, b in pairs])
    names = dict(CFG.trip_groups)
    for row in trips.add_columns(rows, labels(spark), CFG).collect():
        ends = (fine[row[CFG.origin]], fine[row[CFG.destination]])
        first = min(ends, key=order.index)
        assert row.trip_group == names.get(first)
        assert row.trip_group_coarse == dict(CFG.coarse_groups).get(row.trip_group)


def test_unlabelled_zone_vanishes_from_analysis_but_not_from_the_audit(spark):
    rows = frame(spark, [trip(**{CFG.origin: 999}), trip(**{CFG.origin: 5, CFG.destination: 999})])
    assert trips.add_columns(rows, labels(spark), CFG).count() == 0
    audit = trips.removals_by_group(rows, labels(spark), CFG).collect()
    assert sorted((r.trip_group, r.rows) for r in audit) == [("ring", 1), ("unknown_zone", 1)]


def test_removal_shares_add_up(spark):
    rows = frame(spark, [trip()] * 2 + [trip(**change) for change in FAILING.values()])
    removals = trips.removals_by_group(rows, labels(spark), CFG)
    shares = {r.rule: r for r in trips.removal_shares(removals, CFG).collect()}
    total = sum(shares[rule]["treated_2025"] for rule in shares if rule != "all rules")
    assert shares["all rules"]["treated_2025"] == pytest.approx(total)


def test_bands_wrap_past_midnight(spark):
    hours = spark.range(24).select("id", C.time_band(F.col("id"), CFG).alias("band")).collect()
    expected = {**dict.fromkeys(range(5), "overnight"), **dict.fromkeys(range(5, 10), "morning_peak")}
    expected |= {**dict.fromkeys(range(10, 16), "midday"), **dict.fromkeys(range(16, 21), "evening")}
    expected |= dict.fromkeys(range(21, 24), "overnight")
    assert {r.id: r.band for r in hours} == expected


def test_calendar_columns(spark):
    row = trips.add_columns(frame(spark, [trip()]), labels(spark), CFG).first()
    assert (row.date, row.hour, row.time_band) == (date(2025, 3, 12), 10, "midday")
    assert row.day_of_week == 3 and row.after_toll


# The stage table --------------------------------------------------------------


def test_stage_table_gives_what_the_operators_give(spark, tmp_path):
    from stepchange.sources import staged

    rng = __import__("random").Random(3)
    made = [
        trip(
            **{
                CFG.origin: rng.choice([1, 2, 3, 4, 264, 99, None]),
                CFG.destination: rng.choice([1, 2, 3, 4, 265, 99]),
                CFG.distance: rng.choice([0.0, 2.0, 150.0, None]),
                CFG.pay: rng.choice([-1.0, 20.0, 900.0, None]),
            }
        )
        for _ in range(300)
    ]
    raw, zones = spark.createDataFrame(made, SCHEMA), labels(spark)
    staged.write_months(staged.stage(raw, zones, CFG), str(tmp_path / "stage"))
    stored = spark.read.parquet(str(tmp_path / "stage"))
    for one, other in (
        (staged.raw(stored, CFG), raw),
        (staged.cleaned(stored, CFG), trips.clean(trips.add_trip_time(raw, CFG), CFG)),
        (staged.analysed(stored, CFG), trips.analysed(raw, zones, CFG)),
        (trips.cleaning_funnel(staged.timed(stored, CFG), CFG, 9), trips.cleaning_funnel(trips.add_trip_time(raw, CFG), CFG, 9)),
        (
            trips.removals_by_group(staged.timed(stored, CFG), zones, CFG),
            trips.removals_by_group(trips.add_trip_time(raw, CFG), zones, CFG),
        ),
    ):
        assert sorted(one.columns) == sorted(other.columns)
        assert one.select(*other.columns).exceptAll(other).count() == 0 == other.exceptAll(one.select(*other.columns)).count()
        assert other.count() > 0
    # The rules are one comparison on a stored column, which reaches the files
    plan = staged.analysed(stored, CFG).select(CFG.pay)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo({trips.FAILED}," in plan.split("PushedFilters")[1] and "Join" not in plan
    assert "trip_miles" not in plan.split("ReadSchema")[1]


def test_stages_are_stored_once_and_again_after_a_change(spark, tmp_path):
    from stepchange.sources import staged

    stages, built = staged.Stages(), []
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 as twice")

    def get():
        return stages.get(spark, "t", [source], build, lambda: str(tmp_path / f"out{len(built)}"))

    assert sorted(r.twice for r in get().collect()) == sorted(r.twice for r in get().collect()) == [0, 2, 4, 6, 8]
    assert len(built) == 1
    spark.range(7).write.mode("overwrite").parquet(source)
    assert get().count() == 7 and len(built) == 2


def test_stages_are_written_in_short_methods_and_once_for_all_threads(spark, tmp_path):
    import time
    from concurrent.futures import ThreadPoolExecutor

    from stepchange.sources import staged

    stages, built, limits = staged.Stages(), [], []
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)

    def build():
        built.append(1)
        time.sleep(1)
        return spark.read.parquet(source)

    def write(table, path):
        limits.append(int(spark.conf.get(name)))
        staged.write_whole(table, path)

    def get(_):
        return stages.get(spark, "t", [source], build, lambda: str(tmp_path / f"out{len(built)}"), write).count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(get, range(2))) == [5, 5]
    assert len(built) == 1 and limits == [8000]
    assert spark.conf.get(name) == before
