"""Features, boosting, accuracy, effects and Shapley values."""

from dataclasses import replace
from datetime import date, timedelta
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.operators import attribution, forecast

CFG = replace(
    StudyConfig(),
    service="s",
    first_month=date(2023, 1, 1),
    last_month=date(2024, 12, 1),
    intervention=date(2024, 1, 5),
    weather=("rain_mm",),
)
PARAMS = forecast.BoostParams(rounds=4, learning_rate=0.5, depth=3, min_rows=5, checkpoint_every=2)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for zone, (group, coarse) in enumerate([("treated", "treated"), ("ring_adjacent", "ring"), ("control_far", "control")]):
        for band in ("midday", "evening"):
            for year in (2023, 2024):
                for t in range(0, 364, 4):
                    day = date(year, 1, 1) + timedelta(t)
                    level = (2 + 3 * zone) * (2 if band == "evening" else 1) * (1.5 if day.isoweekday() > 5 else 1)
                    trips = int(rng.poisson(level))
                    rows.append((zone, group, band, day, group, coarse, day.isoweekday(), False, float(t % 7), trips, trips * 10.0))
    return spark.createDataFrame(
        rows,
        "PULocationID int, dropoff_group string, time_band string, date date, trip_group string, "
        "trip_group_coarse string, day_of_week int, is_holiday boolean, rain_mm double, trips long, "
        "total_earnings double",
    ).cache()


@pytest.fixture(scope="module")
def fitted(spark, table):
    from stepchange.sources import files

    files.use_checkpoints(spark)
    return forecast.year_split(table, "trips", CFG, PARAMS)


def test_usual_level_reads_training_rows_only(table):
    inputs = forecast.features(table, F.year("date") == 2023, "trips", CFG)
    changed = table.withColumn("trips", F.when(F.year("date") == 2024, F.col("trips") * 100).otherwise(F.col("trips")))
    again = forecast.features(changed, F.year("date") == 2023, "trips", CFG)
    assert inputs.select("usual").distinct().count() == 6
    assert inputs.select("usual").exceptAll(again.select("usual")).count() == 0
    unseen = forecast.features(table, (F.year("date") == 2023) & (F.col("PULocationID") > 0), "trips", CFG)
    assert unseen.where("PULocationID = 0 and usual is not null").count() == 0


@pytest.mark.parametrize("target", forecast.TARGETS)
def test_deviance_falls_round_by_round(table, target):
    inputs = forecast.features(table, F.year("date") == 2023, target, CFG)
    found = []
    for rounds in (0, 1, 4):
        model = forecast.boost(inputs, target, CFG, replace(PARAMS, rounds=rounds))
        found.append({r.is_train: r.deviance for r in forecast.deviance(model.rows, target).collect()})
        model.release()
    assert found[0][True] > found[1][True] > found[2][True]
    # and the forecast beats the constant on the year it has not seen
    assert found[2][False] < found[0][False]


def test_forecast_splits_leave_the_first_days_out(table, fitted):
    _, rows = fitted
    assert rows.agg(F.min("date"), F.max("date")).first()[0].year == 2024
    model, toll = forecast.forecast(table, "trips", CFG, replace(PARAMS, rounds=1))
    assert toll.agg(F.min("date")).first()[0] == date(2024, 1, 5)
    assert model.rows.where("is_train").agg(F.max("date")).first()[0].year == 2023


def test_registered_forecasts_take_all_rounds_of_the_study(spark, monkeypatch):
    from stepchange.plans import catalog, catalog_models

    asked = []
    monkeypatch.setattr(catalog_models, "_FITS", {})
    monkeypatch.setattr(catalog_models.staged, "fingerprint", lambda *_: "")
    monkeypatch.setattr(catalog, "kept_model_table", lambda *_: None)
    for fit in ("year_split", "forecast"):
        monkeypatch.setattr(forecast, fit, lambda table, target, cfg, params: asked.append(params) or (None, None))
    for kind in ("year", "toll"):
        catalog_models._fits(spark, "", kind)
    # The study's 300 trees of 63 leaves and steps of 0.1, for both targets
    assert [(p.rounds, p.learning_rate, p.leaves) for p in asked] == [(300, 0.1, 63)] * 4


def test_shapley_values_add_up_to_the_score(fitted):
    model, _ = fitted
    rows = model.rows.where("not is_train")
    explained, base = attribution.explain(model, rows)
    for row in explained.collect():
        assert base + sum(row["values"]) == pytest.approx(row.score, abs=1e-9)
    importance = attribution.shap_importance(model, CFG, n=100).collect()
    assert {r.input for r in importance} == set(model.inputs)
    assert importance[0].mean_abs_shap == max(r.mean_abs_shap for r in importance)


def test_shapley_values_of_few_rows_are_those_among_many(fitted):
    model, _ = fitted
    own = attribution.Explained.of(model.model.trees[0])
    sizes = model.model.binning.sizes
    bins = np.stack([np.random.default_rng(i).integers(0, n, 500) for i, n in enumerate(sizes)], axis=1)
    assert any(leaf.path for leaf in own.leaves)
    for few in (1, 4):
        assert own.values(bins[:few]) == pytest.approx(own.values(bins)[:few], abs=1e-12)


def test_shapley_values_match_every_subset():
    def split(feature, threshold, left):
        return attribution.Condition(feature, threshold, frozenset(), left)

    def on(feature, members, left):
        return attribution.Condition(feature, None, frozenset(members), left)

    leaves = [
        attribution.Leaf(1.0, (split(0, 0.5, True), on(1, {0.0, 2.0}, True))),
        attribution.Leaf(-2.0, (split(0, 0.5, True), on(1, {0.0, 2.0}, False))),
        attribution.Leaf(4.0, (split(0, 0.5, False), split(0, 0.8, True), split(2, 0.1, True))),
        attribution.Leaf(0.5, (split(0, 0.5, False), split(0, 0.8, True), split(2, 0.1, False))),
        attribution.Leaf(3.0, (split(0, 0.5, False), split(0, 0.8, False))),
    ]
    covers = [3, 7, 4, 1, 5]
    rates = attribution._pass_rates(leaves, covers)
    x = np.random.default_rng(2).random((30, 3))
    x[:, 1] = np.random.default_rng(3).integers(0, 3, 30)

    def expectation(known):
        total = np.zeros(len(x))
        for leaf, rate in zip(leaves, rates):
            weight = np.ones(len(x))
            for condition, passed in zip(leaf.path, rate):
                weight *= condition.holds(x) if condition.feature in known else passed
            total += leaf.value * weight
        return total

    found = attribution.shapley_values(x, leaves, rates)
    for feature in range(3):
        others = [f for f in range(3) if f != feature]
        expected = sum(
            factorial(size) * factorial(2 - size) / factorial(3) * (expectation({*known, feature}) - expectation(set(known)))
            for size in range(3)
            for known in combinations(others, size)
        )
        assert found[:, feature] == pytest.approx(expected)


def test_accuracy_skips_missing_forecasts_but_not_their_actuals(spark):
    rows = spark.createDataFrame([(10.0, 12.0), (10.0, 9.0), (20.0, None)], "actual double, predicted double")
    row = forecast.accuracy(rows).first()
    assert (row.mae, row.wmape_pct) == (1.5, 7.5)
    assert row.rmse == pytest.approx(np.sqrt(2.5))


def test_effect_of_equal_years_is_zero_and_control_is_divided_out(spark):
    rows = spark.createDataFrame(
        [("treated", "treated", 90.0, 100.0), ("control_far", "control", 60.0, 50.0), ("control_near", "control", 60.0, 50.0)],
        "trip_group string, trip_group_coarse string, actual double, predicted double",
    )
    found = {r.trip_group: (r.gap_pct, r.effect_pct) for r in forecast.forecast_effect(rows).collect()}
    assert found["treated"] == (pytest.approx(-10.0), pytest.approx(-25.0))
    assert found["control_far"] == (pytest.approx(20.0), pytest.approx(0.0))
    same = forecast.forecast_effect(rows.withColumn("predicted", F.col("actual")))
    assert {(r.gap_pct, r.effect_pct) for r in same.collect()} == {(0.0, 0.0)}


def test_baseline_is_the_same_weekday_52_weeks_earlier(table):
    row = forecast.seasonal_naive(table, CFG).where("date = date'2024-01-01' and PULocationID = 0 and time_band = 'midday'").first()
    earlier = table.where("date = date'2023-01-02' and PULocationID = 0 and time_band = 'midday'").first()
    assert row.naive_trips == (earlier.trips if earlier else None)


def test_side_by_side_table_keeps_its_fixed_rows(spark, fitted):
    from stepchange.operators import did, report

    effects = did.effects_table(spark, [("trips", "headline", "treated", "all", -5.0, -6.0, -4.0, 9)])
    rows = report.comparison(effects, {"trips": fitted[1]}, CFG).collect()
    assert [(r.group, r.term) for r in rows][:2] == [("treated", "all"), ("treated", "overnight")]
    assert len(rows) == 7 and rows[0].did_trips_pct == -5.0 and rows[1].did_trips_pct is None
    assert rows[0].forecast_trips_pct is not None
