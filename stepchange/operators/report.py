"""The two models side by side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.operators.did import RING_HALVES
from stepchange.operators.forecast import forecast_effect


def expected_rows(cfg: StudyConfig) -> list[tuple[int, str, str]]:
    """Treated for the whole day and each band, then each ring half."""
    keys = [("treated", "all")]
    keys += [("treated", band) for band in cfg.band_names]
    keys += [(half, "all") for half in RING_HALVES]
    return [(position, *key) for position, key in enumerate(keys)]


def comparison(
    effects: DataFrame, forecasts: Mapping[str, DataFrame], cfg: StudyConfig
) -> DataFrame:
    """Effects of both models on one fixed list of groups and terms (%)."""
    spark = effects.sparkSession
    table = spark.createDataFrame(expected_rows(cfg), "position int, group string, term string")
    keys = ["group", "term"]
    for outcome, prefix in (("trips", "did_trips"), ("log_eph", "did_pay")):
        fits = effects.where(
            (F.col("outcome") == outcome) & F.col("check").isin("headline", "by time band")
        )
        table = table.join(
            fits.select(
                *keys,
                F.col("effect_pct").alias(f"{prefix}_pct"),
                F.col("ci_low_pct").alias(f"{prefix}_low_pct"),
                F.col("ci_high_pct").alias(f"{prefix}_high_pct"),
            ),
            keys,
            "left",
        )
    for target, rows in forecasts.items():
        whole = forecast_effect(rows).select(
            F.col("trip_group").alias("group"), F.lit("all").alias("term"), "effect_pct"
        )
        bands = forecast_effect(rows, "trip_group_coarse", ["time_band"]).select(
            F.col("trip_group_coarse").alias("group"), F.col("time_band").alias("term"), "effect_pct"
        )
        both = whole.unionByName(bands).withColumnRenamed("effect_pct", f"forecast_{target}_pct")
        table = table.join(both, keys, "left")
    return table.orderBy("position")
