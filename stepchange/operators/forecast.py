"""The no-intervention forecast: features, boosted trees, accuracy and effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepchange.config import StudyConfig
from stepchange.functions import columns as C
from stepchange.operators.boosting import BoostParams, Ensemble, boost_trees
from stepchange.operators.compare import flag_busiest
from stepchange.sources.files import shared_folder

TARGETS = ("trips", "total_earnings")
YEAR_OF_WEEKS = 364
TWEEDIE_POWER = 1.5


# Baseline and features ------------------------------------------------------


def seasonal_naive(cube: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Every row with the same cell's values 52 weeks earlier (null if none)."""
    # One row a cell and date: a cell's rows are the days of the study
    days = F.unix_date("date")
    earlier = W.partitionBy(*cfg.cell).orderBy(days).rangeBetween(-YEAR_OF_WEEKS, -YEAR_OF_WEEKS)
    return cube.select(
        "*", *[F.first(target).over(earlier).alias(f"naive_{target}") for target in TARGETS]
    )


def usual_level(train: DataFrame, targets: Mapping[str, str], cfg: StudyConfig) -> DataFrame:
    """Each cell's mean of the targets over the training rows."""
    return train.groupBy(*cfg.cell).agg(
        *[
            (C.exact_sum(target) / F.count("*")).alias(name)
            for target, name in targets.items()
        ]
    )


def features(table: DataFrame, train: Column, target: str, cfg: StudyConfig) -> DataFrame:
    """Model inputs of every row, with the target and a training flag.

    ``usual`` is averaged over training rows only, so no later value leaks in; a
    cell the training rows don't have gets null.
    """
    usual = usual_level(table.where(train), {target: "usual"}, cfg)
    return table.join(usual, cfg.cell, "left").select(
        *cfg.cell,
        "date",
        "trip_group",
        "trip_group_coarse",
        "day_of_week",
        F.month("date").alias("month"),
        F.col("is_holiday").cast("int").alias("is_holiday"),
        *cfg.weather,
        F.year("date").alias("year"),
        "usual",
        F.col(target).cast("double").alias("actual"),
        train.alias("is_train"),
    )


# Boosted trees --------------------------------------------------------------


@dataclass
class Boosted:
    """Scored rows, and the fitted trees that scored them."""

    rows: DataFrame
    params: BoostParams
    model: Ensemble

    @property
    def inputs(self) -> list[str]:
        return list(self.model.binning.names)

    @property
    def base(self) -> float:
        return self.model.base

    def release(self) -> None:
        """Scored rows are a stored table: nothing is held in memory."""


def _trips_loss(y: np.ndarray, score: np.ndarray):
    """Gradient, curvature and deviance of each row at a score (log link): counts."""
    mu = np.exp(score)
    logs = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0.0)
    return mu - y, mu, 2 * (logs - (y - mu))


def _earnings_loss(y: np.ndarray, score: np.ndarray):
    """The same for money, which is 0 in some cells and continuous in others."""
    mu, p = np.exp(score), TWEEDIE_POWER
    low, high = y * mu ** (1 - p), mu ** (2 - p)
    unit = 2 * (y ** (2 - p) / ((1 - p) * (2 - p)) - low / (1 - p) + high / (2 - p))
    return high - low, (p - 1) * low + (2 - p) * high, unit


LOSSES = {"trips": _trips_loss, "total_earnings": _earnings_loss}


def boost(
    inputs: DataFrame, target: str, cfg: StudyConfig, params: BoostParams = BoostParams()
) -> Boosted:
    """Newton boosting of the training rows, and the scores of all rows as a stored table.

    Zone, group, band, weekday and month are categories, the rest are numbers; a
    missing number or a category without training rows has a bin of its own.
    """
    folder = shared_folder(inputs.sparkSession)
    # Read for vocabularies, bins, the deal and the scores
    inputs.write.parquet(f"{folder}/inputs")
    inputs = inputs.sparkSession.read.parquet(f"{folder}/inputs")
    train = inputs.where("is_train")
    base = train.agg(F.log(F.avg("actual"))).first()[0]
    if base is None or base == float("-inf"):
        raise ValueError(f"no positive {target} in the training rows")
    categorical = [*cfg.cell, "day_of_week", "month"]
    numeric = ["is_holiday", *cfg.weather, "year", "usual"]
    model = boost_trees(
        train, categorical, numeric, LOSSES[target], float(base), params, [*cfg.cell, "date"]
    )
    model.score(inputs).write.parquet(f"{folder}/scored")
    return Boosted(inputs.sparkSession.read.parquet(f"{folder}/scored"), params, model)


def deviance(rows: DataFrame, target: str) -> DataFrame:
    """Mean deviance of scored rows, split by training flag."""
    y, mu = F.col("actual"), F.exp("score")
    if target == "trips":
        logs = F.when(y > 0, y * F.log(y / mu)).otherwise(0.0)
        unit = 2 * (logs - (y - mu))
    else:
        p = TWEEDIE_POWER
        unit = 2 * (
            F.pow(y, 2 - p) / ((1 - p) * (2 - p))
            - y * F.pow(mu, 1 - p) / (1 - p)
            + F.pow(mu, 2 - p) / (2 - p)
        )
    return rows.groupBy("is_train").agg(F.avg(unit).alias("deviance"))


def _predictions(model: Boosted, test: Column, cfg: StudyConfig) -> DataFrame:
    return model.rows.where(test).select(
        *cfg.cell,
        "date",
        "trip_group",
        "trip_group_coarse",
        "actual",
        F.exp("score").alias("predicted"),
    )


def first_two_years(table: DataFrame) -> tuple[int, int]:
    """The first two calendar years in the table."""
    years = table.select(F.year("date").alias("year")).distinct().orderBy("year").head(2)
    return years[0].year, years[1].year


def year_split(
    table: DataFrame, target: str, cfg: StudyConfig, params: BoostParams
) -> tuple[Boosted, DataFrame]:
    """Fit on the first calendar year, forecast the second."""
    first, second = first_two_years(table)
    year = F.year("date")
    rows = table.where(year.isin(first, second))
    model = boost(features(rows, year == first, target, cfg), target, cfg, params)
    return model, _predictions(model, F.year("date") == second, cfg)


def forecast(
    table: DataFrame, target: str, cfg: StudyConfig, params: BoostParams = BoostParams()
) -> tuple[Boosted, DataFrame]:
    """Fit on every earlier calendar year, forecast the days from the start on.

    Days of the start year before the start are in neither part.
    """
    year, day = F.year("date"), F.col("date")
    train = year < cfg.intervention.year
    rows = table.where(train | (day >= F.lit(cfg.intervention)))
    model = boost(features(rows, train, target, cfg), target, cfg, params)
    return model, _predictions(model, ~F.col("is_train"), cfg)


# Accuracy -------------------------------------------------------------------


def accuracy(
    rows: DataFrame, actual: str = "actual", predicted: str = "predicted", keys: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE and WMAPE (%). Rows without a forecast count in no error."""
    error = F.col(predicted) - F.col(actual)
    return rows.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (C.ratio(F.sum(F.abs(error)), F.sum(actual)) * 100).alias("wmape_pct"),
    )


def baseline_scores(cube: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Accuracy of the 52-week baseline in the second calendar year."""
    first, second = first_two_years(cube)
    rows = seasonal_naive(cube.where(F.year("date").isin(first, second)), cfg).where(
        F.year("date") == second
    )
    parts = [
        accuracy(rows, target, f"naive_{target}").select(
            F.lit(target).alias("target"),
            F.lit("52-week baseline").alias("forecast"),
            "mae",
            "rmse",
            "wmape_pct",
        )
        for target in TARGETS
    ]
    return parts[0].unionByName(parts[1])


def validation(
    table: DataFrame, rows: Mapping[str, DataFrame], cfg: StudyConfig
) -> DataFrame:
    """Accuracy of forecasts of the second year and of the baseline, by target."""
    parts = [baseline_scores(table, cfg)]
    for target, found in rows.items():
        parts.append(
            accuracy(found).select(
                F.lit(target).alias("target"),
                F.lit("model").alias("forecast"),
                "mae",
                "rmse",
                "wmape_pct",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def validate(table: DataFrame, cfg: StudyConfig, params: BoostParams = BoostParams()) -> DataFrame:
    """Fit on the first year and score the second, beside the baseline."""
    rows = {target: year_split(table, target, cfg, params)[1] for target in TARGETS}
    return validation(table, rows, cfg)


# Effects --------------------------------------------------------------------


def forecast_effect(
    rows: DataFrame, group: str = "trip_group", by: Sequence[str] = ()
) -> DataFrame:
    """Gap between actual and forecast, and the gap relative to control rows."""
    in_control = F.col("trip_group_coarse") == "control"
    sums = rows.groupBy(*by, group).agg(
        F.sum("actual").alias("actual"),
        F.sum("predicted").alias("predicted"),
        F.sum(F.when(in_control, F.col("actual"))).alias("control_actual"),
        F.sum(F.when(in_control, F.col("predicted"))).alias("control_predicted"),
    )
    # One row a group by now: control totals over the groups of each split
    split = W.partitionBy(*(by or [F.lit(0)]))
    control = C.ratio(
        F.sum("control_actual").over(split), F.sum("control_predicted").over(split)
    )
    gap = C.ratio(F.col("actual"), F.col("predicted"))
    return sums.withColumn("control", control).select(
        *by,
        group,
        ((gap - 1) * 100).alias("gap_pct"),
        ((F.try_divide(gap, F.col("control")) - 1) * 100).alias("effect_pct"),
    )


def placebo_effects(rows: Mapping[str, DataFrame]) -> DataFrame:
    """Effects of forecasts in a year without an intervention, by target."""
    parts = []
    for target, found in rows.items():
        effect = forecast_effect(found)
        parts.append(effect.select(F.lit(target).alias("target"), *effect.columns))
    return reduce(DataFrame.unionByName, parts)


def forecast_placebo(
    table: DataFrame, cfg: StudyConfig, params: BoostParams = BoostParams()
) -> DataFrame:
    """Forecast effects in a year without an intervention: they should be near 0."""
    return placebo_effects({target: year_split(table, target, cfg, params)[1] for target in TARGETS})


def zone_errors(
    rows: DataFrame, table: DataFrame, cfg: StudyConfig, year: int, n: int = 8
) -> DataFrame:
    """The n origin zones with the largest absolute errors in trips."""
    zone = cfg.origin
    error = F.abs(F.col("predicted") - F.col("actual"))
    zones = rows.groupBy(zone).agg(
        F.sum("actual").alias("trips"),
        F.sum("predicted").alias("predicted"),
        F.sum(error).alias("abs_error"),
    )
    before = (
        table.where(F.year("date") == year - 1).groupBy(zone).agg(F.sum("trips").alias("before"))
    )
    total = F.sum("abs_error").over(W.partitionBy(F.lit(0)))
    return (
        zones.withColumn("share", C.ratio(F.col("abs_error"), total) * 100)
        .join(before, zone, "left")
        .orderBy(F.col("abs_error").desc(), zone)
        .limit(n)
        .select(
            zone,
            F.col("share").alias("abs_error_share_pct"),
            "trips",
            "predicted",
            ((C.ratio(F.col("predicted"), F.col("trips")) - 1) * 100).alias("bias_pct"),
            ((C.ratio(F.col("trips"), F.col("before")) - 1) * 100).alias("change_pct"),
        )
    )


def zone_band_gaps(
    rows: DataFrame,
    labels: DataFrame,
    cfg: StudyConfig,
    n: int = 15,
    targets: Sequence[str] = TARGETS,
) -> DataFrame:
    """Gap and control-adjusted effect of every origin zone and band, by target.

    ``rows`` are forecasts stacked with a ``target`` column, so every target is
    summed in one pass.
    """
    in_control = F.col("trip_group_coarse") == "control"
    sums, measures = [], {}
    band = W.partitionBy("time_band")
    for target in targets:
        own = F.col("target") == target
        for value in ("actual", "predicted"):
            sums.append(F.sum(F.when(own, F.col(value))).alias(f"{target}_{value}"))
            sums.append(
                F.sum(F.when(own & in_control, F.col(value))).alias(f"{target}_control_{value}")
            )
        gap = C.ratio(F.col(f"{target}_actual"), F.col(f"{target}_predicted"))
        control = C.ratio(
            F.sum(f"{target}_control_actual").over(band),
            F.sum(f"{target}_control_predicted").over(band),
        )
        measures[f"{target}_gap_pct"] = (gap - 1) * 100
        measures[f"{target}_effect_pct"] = (F.try_divide(gap, control) - 1) * 100
    # One row a zone and band from here on
    table = (
        rows.groupBy(cfg.origin, "time_band")
        .agg(*sums)
        .select(
            cfg.origin,
            "time_band",
            F.col("trips_actual").alias("trips"),
            *[measure.alias(name) for name, measure in measures.items()],
        )
    )
    zone_totals = table.groupBy(cfg.origin).agg(F.sum("trips").alias("zone_trips"))
    names = labels.select(F.col("LocationID").alias(cfg.origin), "Zone", "zone_group")
    return (
        table.join(flag_busiest(zone_totals, cfg.origin, "zone_trips", n), cfg.origin)
        .join(names, cfg.origin, "left")
        .select(
            cfg.origin,
            "Zone",
            "zone_group",
            "time_band",
            "trips",
            "zone_trips",
            "shown",
            *measures,
        )
    )


def sort_gaps(gaps: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Busiest zone first, bands in name order within a zone."""
    return gaps.orderBy(F.col("zone_trips").desc(), cfg.origin, "time_band")


def shown_share(gaps: DataFrame) -> DataFrame:
    """Percent of trips in the zones that are shown."""
    shown = F.sum(F.when(F.col("shown"), F.col("trips")))
    return gaps.agg((C.ratio(shown, F.sum("trips")) * 100).alias("shown_pct"))


def heatmap_pivot(gaps: DataFrame, measures: Sequence[str], cfg: StudyConfig) -> DataFrame:
    """Zones by bands for several measures, busiest zone first."""
    return (
        gaps.groupBy(cfg.origin, "Zone", "zone_trips")
        .pivot("time_band", cfg.band_names)
        .agg(*[F.first(measure).alias(measure) for measure in measures])
        .orderBy(F.col("zone_trips").desc(), cfg.origin)
    )
