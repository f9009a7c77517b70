"""The summary cube: origin zone x drop-off group x date x time band."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.functions import columns as C
from stepchange.functions.quantiles import group_quantiles
from stepchange.operators.trips import analysed, known_groups
from stepchange.sources.files import build_missing_months
from stepchange.sources.monthly import month_starts


def summarise(trips: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Trips, known earnings and median engaged-hour pay of every cell and date.

    Sketched medians take one shuffle with map-side partial counts. With
    ``exact_medians`` they are selected exactly in cell-days of any size.
    """
    keys = [cfg.origin, "dropoff_group", "date", "time_band"]
    counts = [
        F.count("*").alias("trips"),
        F.count("earnings").alias("trips_with_earnings"),
        C.exact_sum("earnings").alias("total_earnings"),
    ]
    medians = {"median": F.col("earnings_per_engaged_hour")}
    return group_quantiles(trips, keys, medians, [0.5], cfg, counts).select(
        *keys,
        "trips",
        "trips_with_earnings",
        "total_earnings",
        F.col("median")[0].alias("median_earnings_per_engaged_hour"),
        F.lit(cfg.service).alias("service"),
    )


def valid_cells(labels: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Origin zone and drop-off group of every cell a cleaned trip can be in.

    An unknown end is possible only opposite the seed area.
    """
    seed, unknown = cfg.zone_groups[0], cfg.unknown_group
    destinations = F.array(*map(F.lit, [*cfg.zone_groups, unknown]))
    known = (F.col("pickup_group") != unknown) & (F.col("dropoff_group") != unknown)
    with_seed = (F.col("pickup_group") == seed) | (F.col("dropoff_group") == seed)
    return (
        known_groups(labels, cfg)
        .select(
            F.col("LocationID").alias(cfg.origin),
            F.col("zone_group_fine").alias("pickup_group"),
            F.explode(destinations).alias("dropoff_group"),
        )
        .where(known | with_seed)
    )


def dense_grid(
    labels: DataFrame, cfg: StudyConfig, months: Iterable[date] | None = None
) -> DataFrame:
    """Every service, cell, date and band of the study.

    Dates and bands are exploded on each cell, so no cross join is planned. The
    short list of cells and months is spread first, so many tasks explode it.
    """
    spark = labels.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    months = month_starts(cfg.first_month, cfg.last_month) if months is None else list(months)
    first_days = F.explode(F.array(*[F.lit(month) for month in months]))
    return (
        valid_cells(labels, cfg)
        .select("*", first_days.alias("month"))
        .repartition(tasks, cfg.origin, "dropoff_group", "month")
        .select(
            F.lit(cfg.service).alias("service"),
            cfg.origin,
            "pickup_group",
            "dropoff_group",
            F.explode(F.sequence("month", F.last_day("month"))).alias("date"),
        )
        .select("*", F.explode(F.array(*map(F.lit, cfg.band_names))).alias("time_band"))
    )


def summary_cube(
    facts: DataFrame,
    labels: DataFrame,
    cfg: StudyConfig,
    months: Iterable[date] | None = None,
) -> DataFrame:
    """The dense cube: facts on the grid, empty cells as 0, medians left null.

    ``facts`` is the output of ``summarise``. It is already partitioned on the
    join keys, so only the grid moves for the join.
    """
    keys = [cfg.origin, "dropoff_group", "date", "time_band"]
    trip_group = C.trip_group(F.col("pickup_group"), F.col("dropoff_group"), cfg)
    return (
        dense_grid(labels, cfg, months)
        .join(facts.drop("service"), keys, "left")
        .withColumn("trip_group", trip_group)
        .select(
            "service",
            cfg.origin,
            "dropoff_group",
            "date",
            "time_band",
            "pickup_group",
            F.coalesce("trips", F.lit(0)).cast("long").alias("trips"),
            F.coalesce("trips_with_earnings", F.lit(0)).cast("long").alias("trips_with_earnings"),
            F.coalesce("total_earnings", F.lit(0.0)).alias("total_earnings"),
            "median_earnings_per_engaged_hour",
            "trip_group",
            C.coarse_group(F.col("trip_group"), cfg).alias("trip_group_coarse"),
            (F.col("date") >= F.lit(cfg.intervention)).alias("after_toll"),
            C.day_of_week(F.col("date")).alias("day_of_week"),
        )
    )


def sort_cube(cube: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The cube in its key order, with bands in the study's order."""
    return cube.orderBy(
        "service",
        cfg.origin,
        "dropoff_group",
        "date",
        C.band_order(F.col("time_band"), cfg),
    )


def build_cube(raw: DataFrame, labels: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Raw trips to the dense cube, as one plan."""
    return summary_cube(summarise(analysed(raw, labels, cfg), cfg), labels, cfg)


def incremental_facts(
    spark: SparkSession,
    raw: DataFrame,
    labels: DataFrame,
    cfg: StudyConfig,
    path: str,
    months: Sequence[date],
    overwrite: bool = False,
) -> DataFrame:
    """Summary facts with finished months read back instead of rebuilt."""

    def build(missing: list[date]) -> DataFrame:
        rows = raw.where(F.col("file_month").isin(missing))
        facts = summarise(analysed(rows, labels, cfg), cfg)
        # The first rule keeps only pickups inside their file's month
        return facts.withColumn("file_month", F.trunc("date", "month"))

    return build_missing_months(spark, path, months, build, overwrite)
