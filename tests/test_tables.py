"""Histograms, quantiles, the cube and the comparison tables."""

from dataclasses import replace
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.functions import columns as C
from stepchange.functions import quantiles
from stepchange.functions.quantiles import exact_quantiles, group_quantiles
from stepchange.operators import compare, labels as names, profile, summary

CFG = replace(
    StudyConfig(), first_month=date(2025, 1, 1), last_month=date(2025, 1, 1), seed_zones=(1,)
)


# Distributions --------------------------------------------------------------


def test_histogram_edges(spark):
    values = [-5.0, 0.0, 1.99, 2.0, 3.0, 5.99, 6.0, 99.0, None]
    data = spark.createDataFrame([(v,) for v in values], "x double")
    rows = profile.histogram(data, "x", 0, 6, 2).orderBy("bin").collect()
    assert [(r.left, r["count"]) for r in rows] == [(0.0, 3), (2.0, 2), (4.0, 3)]


def test_histogram_of_no_rows_has_every_bin(spark):
    data = spark.createDataFrame([], "x double")
    rows = profile.histogram(data, "x", 0, 6, 2).collect()
    assert [r["count"] for r in rows] == [0, 0, 0]


def test_many_histograms_equal_single_ones(spark):
    data = spark.range(200).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 29).cast("double").alias("y"))
    both = profile.histograms(data, [("x", 0, 10, 1), ("y", 5, 20, 2.5)])
    for spec in [("x", 0, 10, 1), ("y", 5, 20, 2.5)]:
        single = profile.histogram(data, *spec).orderBy("bin").collect()
        part = both.where(F.col("column") == spec[0]).orderBy("bin").drop("column").collect()
        assert part == single


def test_binned_quantile_labels(spark):
    cfg = replace(CFG, quantile_specs=(("trip_miles", 0, 10, 1),), quantile_probs=(0.1, 0.5, 0.999))
    miles = [0.5] * 4 + [4.2] * 4 + [50.0] * 2
    data = spark.createDataFrame([(60, m) for m in miles], "trip_seconds long, trip_miles double")
    rows = profile.distribution_quantiles(data, cfg).orderBy("quantile").collect()
    assert [r.trip_miles for r in rows] == ["<1", "5.0", "10+"]


def test_end_bin_share(spark):
    counts = spark.createDataFrame(
        [("raw", "m", 0, 1), ("raw", "m", 1, 6), ("raw", "m", 2, 3)], "stage string, column string, bin int, count long"
    )
    row = profile.end_bin_share(counts, "m").first()
    assert (row.first_bin_pct, row.last_bin_pct) == (10.0, 30.0)


@pytest.mark.parametrize("size", [1, 2, 5, 400])
def test_exact_quantiles_take_the_lower_rank(spark, size):
    rng = np.random.default_rng(size)
    values = rng.integers(-20, 60, size) / 3
    rows = [("a", float(v)) for v in values] + [("b", None), (None, 1.0)]
    data = spark.createDataFrame(rows, "k string, v double")
    found = exact_quantiles(data, ["k"], {"v": F.col("v")}, [0.1, 0.5, 0.9]).collect()
    expected = [sorted(values)[max(int(np.ceil(round(p * size, 6))), 1) - 1] for p in (0.1, 0.5, 0.9)]
    assert {r.k: r.v for r in found} == {"a": expected}


def test_sketched_and_exact_medians_agree_on_small_groups(spark):
    data = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    got = [
        {r.k: (r.n, r.v) for r in group_quantiles(data, ["k"], {"v": F.col("v")}, [0.5], cfg, [F.count("*").alias("n")]).collect()}
        for cfg in (CFG, replace(CFG, exact_medians=True))
    ]
    assert got[0] == got[1]


def test_cell_medians_are_exact_in_large_cells(spark):
    rng = np.random.default_rng(8)
    cells = {zone: rng.gamma(2, 20, 5000) for zone in range(4)}
    rows = [(zone, "g", date(2025, 1, 1), "midday", float(v), float(v)) for zone, values in cells.items() for v in values]
    rows += [(9, "g", date(2025, 1, 1), "midday", 1.0, None)]
    trips = spark.createDataFrame(
        rows,
        f"{CFG.origin} int, dropoff_group string, date date, time_band string, earnings double, "
        "earnings_per_engaged_hour double",
    )
    found = {r[0]: r for r in summary.summarise(trips, replace(CFG, exact_medians=True)).collect()}
    for zone, values in cells.items():
        assert found[zone].median_earnings_per_engaged_hour == sorted(values)[2499]
        assert found[zone].trips == 5000
    assert found[9].median_earnings_per_engaged_hour is None and found[9].trips == 1


def test_one_hot_bin_is_cut_into_parts(spark):
    # All values in one bin of the exact selection, in many parts of it
    data = spark.range(200_000).select(F.lit("a").alias("k"), ((F.col("id") * 7919 % 200_003) / 500_000).alias("v"))
    values = sorted(i * 7919 % 200_003 / 500_000 for i in range(200_000))
    found = exact_quantiles(data, ["k"], {"v": F.col("v")}, [0.25, 0.5]).first()
    assert found.v == [values[49_999], values[99_999]]


ODD_DOUBLES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1074 * 3, 1.7e308, -1.7e308, 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 8.0, np.nextafter(8, 0)]


def test_large_groups_are_located_like_small_ones(spark):
    rng = np.random.default_rng(4)
    values = [*ODD_DOUBLES, *rng.normal(0, 1, 300), *(5 + rng.random(300) * 1e-4), *rng.integers(-3, 3, 200).astype(float), float("inf"), -float("inf")]
    rows = [("a", float(v), float(-v)) for v in values] + [("a", None, 1.0), ("b", 1.0, None), (None, 2.0, 3.0)]
    data = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    probs, measures, counts = [0.001, 0.1, 0.25, 0.5, 0.75, 0.999], {"v": F.col("v"), "w": F.col("w")}, [F.count("*").alias("n")]
    small = {r.k: r for r in exact_quantiles(data, ["k"], measures, probs, counts).collect()}
    large = {r.k: r for r in exact_quantiles(data, ["k"], measures, probs, counts, small=0).collect()}
    mixed = {r.k: r for r in exact_quantiles(data, ["k"], measures, probs, counts, small=10).collect()}
    assert small == large == mixed and set(small) == {"a", "b", None}
    ordered = sorted(values)
    assert small["a"].v == [ordered[max(int(np.ceil(round(p * len(values), 6))), 1) - 1] for p in probs]
    assert small["a"].n == len(values) + 1 and small["b"].w is None and small[None].v == [2.0] * 6


def test_parts_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(5)
    values = sorted([*ODD_DOUBLES, *rng.normal(0, 1e-200, 500), *rng.normal(0, 1e200, 500), *(1 + rng.random(500) * 1e-12), float("inf"), -float("inf")])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = rows.select("v", *[p.alias(f"p{i}") for i, p in enumerate(quantiles._parts(F.col("v")))]).collect()
    keys = [(r.p0, r.p1, r.p2) for r in sorted(found, key=lambda r: r.v)]
    assert keys == sorted(keys)


def test_close_values_of_a_hot_group_are_spread(spark):
    # Five million distinct values within 1e-4: no part that is put in order has more than a hundredth of them
    value = 5 + F.col("id") * 2e-11
    data = spark.range(5_000_000, numPartitions=8).select(value.alias("v"))
    parts = data.groupBy(*quantiles._parts(F.col("v"))).agg(F.count("*").alias("n"), F.countDistinct("v").alias("d"))
    assert parts.agg(F.max("n")).first()[0] < 50_000 and parts.agg(F.sum("d")).first()[0] == 5_000_000


def test_values_of_a_large_group_do_not_move(spark):
    # 300,000 values of one group: counts of parts are shuffled, and the values of a rank's part
    measures = {"v": F.rand(3) * 100, "w": F.rand(4) * 100}
    data = spark.range(300_000, numPartitions=4).select(F.lit("a").alias("k"), *[m.alias(n) for n, m in measures.items()])
    found = exact_quantiles(data, ["k"], {n: F.col(n) for n in measures}, [0.25, 0.5])
    rows = found.collect()
    moved, nodes = [], [found._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            moved.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert moved and max(moved) < 150_000
    values = {n: sorted(getattr(r, n) for r in data.collect()) for n in measures}
    assert [getattr(rows[0], n) for n in measures] == [[v[74_999], v[149_999]] for v in values.values()]


def test_counts_and_small_medians_come_from_one_pass(spark, tmp_path):
    spark.range(4000).select((F.col("id") % 7).alias("k"), (F.col("id") % 101).cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    data = spark.read.parquet(str(tmp_path / "t"))
    found = exact_quantiles(data, ["k"], {"v": F.col("v")}, [0.5], [F.count("*").alias("n")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Once in the first and once in the final part of an adaptive plan at most
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_hourly_shares_and_fees(spark):
    cfg = replace(CFG)
    data = spark.sql(
        "select timestamp_ntz'2025-01-04 10:00:00' as pickup_datetime, 1.5D as cbd_congestion_fee, date'2025-01-01' as file_month "
        "union all select timestamp_ntz'2025-01-06 10:00:00', 1.5D, date'2025-01-01' "
        "union all select timestamp_ntz'2025-01-06 11:00:00', null, date'2025-01-01'"
    )
    rows = {r.hour: (r.weekday, r.weekend) for r in profile.hourly_shares(data, cfg).collect()}
    assert rows == {10: (50.0, 100.0), 11: (50.0, None)}
    fee = profile.fee_values(data, cfg).collect()
    assert [(r.fee, r.trips, r.trips_pct, r.hours) for r in fee] == [(1.5, 2, 100.0, 1)]


# Cube -----------------------------------------------------------------------


@pytest.fixture
def cube(spark):
    zones = spark.createDataFrame(
        [(1, "cbd"), (2, "control_far"), (264, None)], "LocationID int, zone_group_fine string"
    )
    day = date(2025, 1, 6)
    trips = spark.createDataFrame(
        [
            (1, "cbd", day, "midday", 10.0, 30.0),
            (1, "cbd", day, "midday", 12.34, 10.0),
            (1, "cbd", day, "midday", None, None),
            (264, "cbd", day, "evening", 5.0, 20.0),
        ],
        "PULocationID int, dropoff_group string, date date, time_band string, "
        "earnings double, earnings_per_engaged_hour double",
    )
    return summary.summary_cube(summary.summarise(trips, CFG), zones, CFG)


def test_cube_is_dense_and_keeps_every_trip(spark, cube):
    # Two known zones x 5 groups, the seed zone x unknown, the unknown zone x seed
    assert cube.count() == 12 * 31 * 4
    assert cube.agg(F.sum("trips")).first()[0] == 4
    assert len(cube.columns) == 14


def test_cube_fills_counts_but_not_medians(spark, cube):
    empty = cube.where("trips = 0").agg(
        F.count("median_earnings_per_engaged_hour").alias("medians"),
        F.sum("total_earnings").alias("money"),
        F.count_if(F.col("total_earnings").isNull()).alias("nulls"),
    )
    assert tuple(empty.first()) == (0, 0.0, 0)
    busy = cube.where("trips = 3").first()
    assert (busy.trips_with_earnings, busy.total_earnings) == (2, 22.34)
    assert busy.median_earnings_per_engaged_hour == 10.0
    assert (busy.trip_group, busy.day_of_week, busy.after_toll) == ("treated", 1, True)


def test_unknown_cells_only_face_the_seed_area(cube):
    pairs = {tuple(r) for r in cube.select("pickup_group", "dropoff_group").distinct().collect()}
    assert {p for p in pairs if "unknown" in p} == {("cbd", "unknown"), ("unknown", "cbd")}


def test_grid_needs_no_cross_join(cube):
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# Comparisons ----------------------------------------------------------------


def test_pct_change_needs_a_positive_base(spark):
    data = spark.createDataFrame([(4, 5), (0, 5), (-1, 5), (None, 5), (4, 0)], "a int, b int")
    found = [r[0] for r in data.select(C.pct_change(F.col("a"), F.col("b"))).collect()]
    assert found == [25.0, None, None, None, -100.0]


def test_periods_are_closed_and_leave_the_first_days_out(spark):
    days = [date(2024, 1, 4), date(2024, 1, 5), date(2024, 12, 31), date(2025, 1, 4), date(2025, 1, 5), date(2025, 12, 31)]
    data = spark.createDataFrame([(d,) for d in days], "date date")
    found = [r.period for r in compare.add_period(data, CFG).orderBy("date").collect()]
    assert found == [None, "before", "before", None, "after", "after"]


def test_index_base_is_the_mean_of_monthly_ratios(spark):
    rows = [
        ("s", date(2024, 1, 1), "treated", 10), ("s", date(2024, 1, 1), "control", 10), ("s", date(2024, 1, 1), "ring", 5),
        ("s", date(2024, 2, 1), "treated", 90), ("s", date(2024, 2, 1), "control", 30), ("s", date(2024, 2, 1), "ring", 15),
    ]
    data = spark.createDataFrame(rows, "service string, date date, trip_group_coarse string, trips long")
    found = [r.treated for r in compare.relative_trips(data, CFG).orderBy("month").collect()]
    assert found == pytest.approx([50.0, 150.0])


def test_spearman_matches_average_ranks(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.integers(0, 6, 40) * 1.0, "b": rng.integers(0, 6, 40) * 1.0})
    rows = [(i, float(a), float(b), True) for i, (a, b) in enumerate(frame.to_numpy())]
    changes = spark.createDataFrame(rows, "PULocationID int, change_pct double, eph_change_pct double, enough_trips boolean")
    zones = spark.createDataFrame([(i, "z", "cbd" if i < 39 else "ring", "x") for i in range(40)], "LocationID int, Zone string, zone_group string, zone_group_fine string")
    found = {r.group: (r.zones, r.spearman) for r in compare.zone_correlation(changes, zones, CFG).collect()}
    assert found["all shown"] == (40, pytest.approx(frame.rank().corr().iloc[0, 1]))
    assert found["cbd"] == (39, pytest.approx(frame.iloc[:39].rank().corr().iloc[0, 1]))
    assert found["ring"] == (1, None)


def test_ties_are_broken_by_id(spark):
    data = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 1.0), (4, None)], "id int, x double")
    rows = compare.extremes(data, "x", "id", 2).collect()
    assert sorted((r.side, r.id) for r in rows) == [("largest", 1), ("largest", 2), ("smallest", 1), ("smallest", 2)]
    flagged = compare.flag_busiest(data.dropna(), "id", "x", 2).orderBy("id").collect()
    assert [r.shown for r in flagged] == [True, True, False]


def test_speed_change_uses_the_months_of_the_later_year(spark):
    rows = [(date(2024, m, 1), "a", float(m)) for m in range(1, 13)] + [(date(2025, m, 1), "a", 10.0) for m in (1, 2)]
    row = compare.speed_change(spark.createDataFrame(rows, "month date, zone string, zonal_speed double"), CFG).first()
    assert (row.before_mph, row.after_mph) == (1.5, 10.0)


def test_reindex_orders_and_adds_missing_keys(spark):
    data = spark.createDataFrame([("b", 2), ("x", 9)], "k string, n int")
    rows = compare.reindex(data, ["k"], [("a",), ("b",)]).orderBy("position").collect()
    assert [(r.k, r.n) for r in rows] == [("a", None), ("b", 2)]


def test_sample_is_the_same_for_any_partitioning(spark):
    data = spark.range(1000).toDF("k")
    samples = [
        {r.k for r in compare.seeded_sample(data.repartition(n), ["k"], 50).collect()} for n in (1, 7)
    ]
    assert samples[0] == samples[1] and len(samples[0]) == 50


def test_crosstab_margins(spark):
    data = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "r string, c string")
    rows = {r.r: (r.x, r.y, r.Total) for r in compare.crosstab_margins(data, "r", "c", ["x", "y"]).collect()}
    assert rows == {"a": (2, 0, 2), "b": (0, 1, 1), "Total": (2, 1, 3)}


def test_describe_matches_pandas(spark):
    values = [1.0, 2.0, 4.0, 8.0, 16.0]
    data = spark.createDataFrame([(v,) for v in values], "x double")
    found = {r.statistic: r.x for r in compare.describe(data, ["x"]).collect()}
    assert found == pytest.approx(pd.Series(values).describe().to_dict())


def test_labels_and_terms(spark):
    words = ["distance_to_cbd_ft", "ring_across", "Midtown", "area_sq_mi", "null_pct", "zone_id"]
    data = spark.createDataFrame([(w,) for w in words], "w string")
    found = [r[0] for r in data.select(names.value_label(F.col("w"))).collect()]
    assert found == ["Distance to CBD (ft)", "Ring, across water", "Midtown", "Area sq mi", "Null (%)", "Zone ID"]
    terms = ["treated_after", "time_band::midday:ring_after", "ring_across_after", "treated:rain_mm"]
    group, name = names.split_term(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(group.alias("g"), name.alias("n")).collect()
    assert [tuple(r) for r in rows] == [("treated", "all"), ("ring", "midday"), ("ring_across", "all"), ("treated", "rain_mm")]
