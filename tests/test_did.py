"""Both estimators against regressions with every dummy written out."""

from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from stepchange.config import StudyConfig
from stepchange.operators import did
from stepchange.sources import files

BANDS = (("day", 6, 18), ("night", 18, 6))
CFG = replace(
    StudyConfig(),
    service="s",
    first_month=date(2025, 1, 1),
    last_month=date(2025, 1, 1),
    intervention=date(2025, 1, 12),
    placebo=date(2025, 1, 6),
    bands=BANDS,
    weather=("rain_mm",),
)
GROUPS = ["treated", "ring_adjacent", "ring_across", "control_near", "control_far"]
TERMS = tuple(did.Term(g, "after") for g in GROUPS[:3]) + (did.Term("treated", "rain_mm"),)
FIT = did.Fit("headline", TERMS, CFG.intervention)
EFFECTS = (-0.2, 0.1, 0.05)


def panel_frame(days=20, zones=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    rain = rng.integers(0, 5, days) * 1.0
    shocks = rng.normal(0, 0.3, (days, 2))
    for zone in range(zones):
        for number, group in enumerate(GROUPS[: 2 + zone % 4]):
            for b, (band, _, _) in enumerate(BANDS):
                level = rng.normal(1.2, 0.5)
                for t in range(days):
                    after = t >= 11
                    effect = EFFECTS[number] if number < 3 and after else 0.0
                    mean = np.exp(level + shocks[t, b] + effect)
                    trips = 0 if (zone, number, b) == (0, 1, 0) else rng.poisson(mean)
                    rows.append(
                        {
                            "service": "s",
                            "PULocationID": zone,
                            "dropoff_group": group,
                            "time_band": band,
                            "date": date(2025, 1, 1) + timedelta(t),
                            "trip_group": group,
                            "trips": int(trips),
                            "trips_with_earnings": int(rng.integers(0, 4)) if trips else 0,
                            "median_earnings_per_engaged_hour": float(np.exp(rng.normal(3, 0.3) + effect)),
                            "rain_mm": rain[t],
                        }
                    )
    frame = pd.DataFrame(rows)
    frame.loc[frame["trips_with_earnings"] == 0, "median_earnings_per_engaged_hour"] = np.nan
    return frame


def design(frame):
    after = (pd.to_datetime(frame["date"]) >= pd.Timestamp(CFG.intervention)).to_numpy(float)
    x = [after * (frame["trip_group"] == g) for g in GROUPS[:3]]
    x.append(frame["rain_mm"] * (frame["trip_group"] == "treated"))
    return np.column_stack(x)


def dummies(frame):
    cell = frame["PULocationID"].astype(str) + frame["dropoff_group"] + frame["time_band"]
    day = frame["date"].astype(str) + frame["time_band"]
    return pd.get_dummies(cell, dtype=float).to_numpy(), pd.get_dummies(day, dtype=float).to_numpy()


def intervals(frame, x, weights, residual_score, beta, fixed):
    """Cluster-robust percent intervals from dense matrices."""
    root = np.sqrt(weights)[:, None]
    left = x - fixed @ np.linalg.lstsq(fixed * root, x * root, rcond=None)[0]
    bread = np.linalg.inv(left.T @ (left * weights[:, None]))
    meat = np.zeros((x.shape[1],) * 2)
    for zone in frame["PULocationID"].unique():
        s = left[(frame["PULocationID"] == zone).to_numpy()].T @ residual_score[(frame["PULocationID"] == zone).to_numpy()]
        meat += np.outer(s, s)
    n, g = len(frame), frame["PULocationID"].nunique()
    k = x.shape[1] + (frame["date"].astype(str) + frame["time_band"]).nunique()
    variance = bread @ meat @ bread * g / (g - 1) * (n - 1) / (n - k)
    reach = did.t_quantile(0.975, g - 1) * np.sqrt(np.diag(variance))
    return [100 * np.expm1(beta + s * reach) for s in (0, -1, 1)]


def dense_poisson(frame):
    cell = ["PULocationID", "dropoff_group", "time_band"]
    frame = frame[frame.groupby(cell)["trips"].transform("sum") > 0]
    frame = frame[frame.groupby(["date", "time_band"])["trips"].transform("sum") > 0]
    x, fixed = design(frame), np.hstack(dummies(frame))
    full, y = np.hstack([x, fixed]), frame["trips"].to_numpy(float)
    eta = np.log((y + y.mean()) / 2)
    for _ in range(60):
        mu = np.exp(eta)
        root = np.sqrt(mu)
        beta = np.linalg.lstsq(full * root[:, None], (eta + (y - mu) / mu) * root, rcond=None)[0]
        eta = full @ beta
    mu = np.exp(eta)
    return intervals(frame, x, mu, y - mu, beta[: x.shape[1]], fixed), len(frame)


def dense_wls(frame):
    frame = frame[(frame["trips_with_earnings"] > 0)].copy()
    while True:
        alone = frame.groupby(["PULocationID", "dropoff_group", "time_band"])["trips"].transform("size") > 1
        alone &= frame.groupby(["date", "time_band"])["trips"].transform("size") > 1
        if alone.all():
            break
        frame = frame[alone]
    x, fixed = design(frame), np.hstack(dummies(frame))
    full, y = np.hstack([x, fixed]), np.log(frame["median_earnings_per_engaged_hour"].to_numpy())
    w = frame["trips_with_earnings"].to_numpy(float)
    beta = np.linalg.lstsq(full * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    return intervals(frame, x, w, w * (y - full @ beta), beta[: x.shape[1]], fixed), len(frame)


def spark_panel(spark, frame):
    schema = (
        "service string, PULocationID int, dropoff_group string, time_band string, date date, "
        "trip_group string, trips long, trips_with_earnings long, "
        "median_earnings_per_engaged_hour double, rain_mm double"
    )
    rows = [tuple(None if v != v else v for v in row) for row in frame.itertuples(index=False)]
    return did.did_panel(spark.createDataFrame(rows, schema), CFG)


@pytest.fixture(scope="module")
def frame():
    return panel_frame()


@pytest.mark.parametrize("outcome", ["trips", "log_eph"])
def test_estimates_and_intervals_match_dense_dummies(spark, frame, outcome):
    files.use_checkpoints(spark)
    estimate = did.fit_trips if outcome == "trips" else did.fit_pay
    found = estimate(spark_panel(spark, frame), [FIT], CFG)
    expected, rows = (dense_poisson if outcome == "trips" else dense_wls)(frame)
    assert [row[2] for row in found] == GROUPS[:3]
    for position, row in enumerate(found):
        assert row[4:7] == pytest.approx([values[position] for values in expected], rel=1e-6)
        assert row[7] == rows


def test_planted_effects_are_recovered(spark):
    big = panel_frame(days=28, zones=24, seed=3)
    found = did.fit_trips(spark_panel(spark, big), [FIT], CFG)
    for row, effect in zip(found, EFFECTS):
        assert row[5] <= 100 * np.expm1(effect) + 8 and row[6] >= 100 * np.expm1(effect) - 8


def test_row_choices_and_band_terms(spark, frame):
    files.use_checkpoints(spark)
    panel = spark_panel(spark, frame)
    fits = [
        replace(FIT, check="buffer", without_group="control_near"),
        replace(FIT, check="bands", terms=tuple(did.Term("treated", "after", b) for b, _, _ in BANDS)),
    ]
    kept = frame[frame["trip_group"] != "control_near"]
    for estimate, dense in ((did.fit_trips, dense_poisson), (did.fit_pay, dense_wls)):
        found = estimate(panel, fits, CFG)
        expected, rows = dense(kept)
        assert [r[4] for r in found if r[1] == "buffer"] == pytest.approx(expected[0][:3], rel=1e-6)
        assert {r[7] for r in found if r[1] == "buffer"} == {rows}
        assert [r[3] for r in found if r[1] == "bands"] == ["day", "night"]


def test_pay_does_not_depend_on_how_cells_are_spread(spark, frame):
    files.use_checkpoints(spark)
    panel = spark_panel(spark, frame)
    whole = did.fit_pay(panel, [FIT], CFG)
    spread = panel.repartition(7, "date")
    assert [r[4:7] for r in did.fit_pay(spread, [FIT], CFG)] == [pytest.approx(r[4:7], rel=1e-8) for r in whole]


def test_unbalanced_panel_is_refused(spark, frame):
    with pytest.raises(ValueError, match="balanced"):
        did.fit_trips(spark_panel(spark, frame.iloc[1:]), [FIT], CFG)


def test_singletons_are_dropped_until_none_is_left(spark):
    files.use_checkpoints(spark)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3), ("c", 2)], "i string, t int")
    # t=1 and t=3 go first, which leaves a, b and c alone
    assert did.drop_singletons(rows, [["i"], ["t"]]).count() == 0
    pairs = spark.createDataFrame([(i, t) for i in "ab" for t in (1, 2)] + [("c", 9)], "i string, t int")
    assert did.drop_singletons(pairs, [["i"], ["t"]]).count() == 4


@pytest.mark.parametrize("dof, expected", [(1, 12.7062), (5, 2.5706), (24, 2.0639), (1000, 1.9623)])
def test_t_quantile(dof, expected):
    assert did.t_quantile(0.975, dof) == pytest.approx(expected, abs=2e-4)


def test_effects_in_dollars(spark):
    effects = did.effects_table(
        spark,
        [("log_eph", "headline", "treated", "all", 2.0, 1.0, 3.0, 9), ("trips", "headline", "treated", "all", 5.0, 4.0, 6.0, 9)],
    )
    median = spark.createDataFrame([("treated", 50.0)], "trip_group string, median_eph double")
    row = did.effect_dollars(effects, median).collect()
    assert [(r.effect_dollars, r.ci_low_dollars, r.ci_high_dollars) for r in row] == [(1.0, 0.5, 1.5)]
