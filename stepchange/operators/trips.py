"""Trip-level work: time columns, removal rules, zone groups, analysis columns."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepchange.config import StudyConfig
from stepchange.functions import columns as C


def add_trip_time(data: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Add ``trip_seconds``, ``trip_hours`` and ``speed_mph`` (null for 0 hours)."""
    return (
        data.withColumn(
            "trip_seconds",
            C.seconds_between(F.col(cfg.pickup), F.col(cfg.dropoff), cfg.timezone),
        )
        .withColumn("trip_hours", F.col("trip_seconds") / 3600)
        .withColumn("speed_mph", F.try_divide(F.col(cfg.distance), F.col("trip_hours")))
    )


class Rule(NamedTuple):
    """A removal rule. Rows stay where ``keep`` is true; null removes them."""

    name: str
    reason: str
    keep: Column


def rules(cfg: StudyConfig) -> list[Rule]:
    """The removal rules, in the order in which they apply."""
    seconds, pay = F.col("trip_seconds"), F.col(cfg.pay)
    origin, destination = F.col(cfg.origin), F.col(cfg.destination)
    origin_unknown = origin.isin(*cfg.unknown_zones)
    destination_unknown = destination.isin(*cfg.unknown_zones)
    either_unknown = origin_unknown | destination_unknown
    # An unknown end can be placed only if the other end is in the seed area
    placed = (origin_unknown & destination.isin(*cfg.seed_zones)) | (
        destination_unknown & origin.isin(*cfg.seed_zones)
    )
    return [
        Rule(
            "pickup_in_file_month",
            "Pickup date outside the month of the file",
            F.trunc(F.to_date(cfg.pickup), "month") == F.col("file_month"),
        ),
        Rule("dropoff_after_pickup", "Drop-off not after the pickup", seconds > 0),
        Rule("positive_driver_pay", "Zero or negative driver pay", pay > 0),
        Rule(
            "trip_length",
            f"Shorter than {cfg.min_trip_minutes} or longer than {cfg.max_trip_minutes} minutes",
            seconds.between(cfg.min_trip_minutes * 60, cfg.max_trip_minutes * 60),
        ),
        Rule(
            "distance_cap",
            f"Distance over {cfg.max_distance_miles:g} miles",
            F.col(cfg.distance) <= cfg.max_distance_miles,
        ),
        Rule(
            "speed_cap",
            f"Average speed over {cfg.max_speed_mph:g} mph",
            F.col("speed_mph") <= cfg.max_speed_mph,
        ),
        Rule("money_cap", f"Driver pay over ${cfg.max_money:g}", pay <= cfg.max_money),
        Rule(
            "known_zones",
            "An end in an unknown zone and the other end outside the seed area",
            ~either_unknown | placed,
        ),
    ]


#: Position of the first rule that a staged trip fails, or the number of rules.
FAILED = "failed_rule"


def first_failed_position(cfg: StudyConfig) -> Column:
    """Position of the first rule a row fails, or the number of rules; no condition is evaluated twice."""
    steps = rules(cfg)
    return C.first_match(
        ((~C.is_true(rule.keep), number) for number, rule in enumerate(steps)), len(steps)
    )


def _failed(data: DataFrame, cfg: StudyConfig) -> Column:
    """The stored position of a staged trip, or the expression."""
    return F.col(FAILED) if FAILED in data.columns else first_failed_position(cfg)


def clean(data: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Rows that pass every rule.

    A filter drops null results by itself, so the conditions stay bare and those
    on stored columns reach the parquet reader. They come first: the rules on
    derived times only see the rows that are left.
    """
    derived = {"pickup_in_file_month", "dropoff_after_pickup", "trip_length", "speed_cap"}
    ordered = sorted(rules(cfg), key=lambda rule: rule.name in derived)
    return data.where(reduce(Column.__and__, (rule.keep for rule in ordered)))


def cleaning_funnel(data: DataFrame, cfg: StudyConfig, raw_columns: int | str) -> DataFrame:
    """Rows left after each rule, from one aggregate over the data."""
    steps = rules(cfg)
    kept_columns = str(len(cfg.columns))
    failed = _failed(data, cfg)
    counts = [
        F.count_if(F.col("failed") > number).alias(f"s{number}") for number in range(len(steps))
    ]
    totals = data.select(failed.alias("failed")).agg(F.count("*").alias("raw"), *counts)

    def entry(position: int, step: str, reason: str, width: str, rows: str) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(step).alias("step"),
            F.lit(reason).alias("reason"),
            F.lit(width).alias("columns"),
            F.col(rows).alias("rows"),
        )

    entries = [
        entry(0, "raw", "Raw files", str(raw_columns), "raw"),
        entry(1, "keep_columns", "Keep only the columns the study uses", kept_columns, "raw"),
    ] + [
        entry(number + 2, rule.name, rule.reason, kept_columns, f"s{number}")
        for number, rule in enumerate(steps)
    ]
    # One row per rule from here on
    in_order = W.partitionBy("raw").orderBy("position")
    return (
        totals.select("raw", F.explode(F.array(*entries)).alias("entry"))
        .select("raw", "entry.*")
        .withColumn(
            "removed", F.coalesce(F.lag("rows").over(in_order) - F.col("rows"), F.lit(0))
        )
        .withColumn("removed_pct", F.round(C.ratio(F.col("removed"), F.col("raw")) * 100, 3))
        .select("position", "step", "reason", "rows", "columns", "removed", "removed_pct")
        .orderBy("position")
    )


def first_failed_rule(cfg: StudyConfig, position: Column | None = None) -> Column:
    """Name of the first rule a row fails, or ``kept``; ``position`` is a stored one."""
    names = [*(rule.name for rule in rules(cfg)), "kept"]
    position = first_failed_position(cfg) if position is None else position
    return F.element_at(F.array(*map(F.lit, names)), position + 1)


def join_zone_roles(
    data: DataFrame, labels: DataFrame, group: str, cfg: StudyConfig, how: str
) -> DataFrame:
    """Look the zone group up for both ends of every trip.

    ``inner`` drops trips whose zone has no label row; ``left`` keeps them. The
    label table has one row a zone: Catalyst broadcasts it while it is under the
    broadcast threshold, and otherwise shuffles with AQE splitting hot zones.
    """
    groups = labels.select("LocationID", group)
    ends = ((cfg.origin, "pickup_group"), (cfg.destination, "dropoff_group"))
    for column, name in ends:
        role = groups.withColumnsRenamed({"LocationID": column, group: name})
        data = data.join(role, column, how)
    return data


def known_groups(labels: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Zone ids and fine groups, with the unknown group for zones without one."""
    return labels.select(
        F.col("LocationID").cast("int").alias("LocationID"),
        F.coalesce("zone_group_fine", F.lit(cfg.unknown_group)).alias("zone_group_fine"),
    )


def removals_by_group(data: DataFrame, labels: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Raw rows by year, trip group and the first rule they fail."""
    grouped = labels.where(F.col("zone_group").isNotNull())
    named = data.withColumn("rule", first_failed_rule(cfg, _failed(data, cfg)))
    own = named.select(cfg.origin, cfg.destination, "file_month", "rule")
    return (
        join_zone_roles(own, grouped, "zone_group", cfg, "left")
        .groupBy(
            F.year("file_month").alias("year"),
            C.audit_group(F.col("pickup_group"), F.col("dropoff_group")).alias("trip_group"),
            "rule",
        )
        .agg(F.count("*").alias("rows"))
    )


def removal_shares(removals: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Percent of each group-year's raw rows removed by each rule, laid out wide.

    Columns are ``<group>_<year>``. The ``all rules`` row adds the rules up.
    """
    group_year = W.partitionBy("trip_group", "year")
    shares = (
        removals.withColumn("total", F.sum("rows").over(group_year))
        .where(F.col("rule") != "kept")
        .withColumn("share", C.ratio(F.col("rows"), F.col("total")) * 100)
        .withColumn("layout", F.concat_ws("_", "trip_group", "year"))
    )
    layout = [f"{group}_{year}" for group in [*cfg.coarse_names, "unknown_zone"] for year in cfg.years]
    wide = (
        shares.select(F.explode(F.array("rule", F.lit("all rules"))).alias("rule"), "layout", "share")
        .groupBy("rule")
        .pivot("layout", layout)
        .agg(F.sum("share"))
    )
    return wide.fillna(0, subset=layout)


def add_columns(
    data: DataFrame, labels: DataFrame, cfg: StudyConfig, how: str = "inner"
) -> DataFrame:
    """Earnings, zone and trip groups and calendar columns of cleaned trips.

    Earnings are unknown where the distance was not measured. Earnings per
    engaged hour are also unknown for shared rides and a missing shared flag.
    ``how`` says whether trips with an unlabelled zone go (inner) or stay (left).
    """
    day = F.to_date(cfg.pickup)
    joined = join_zone_roles(data, known_groups(labels, cfg), "zone_group_fine", cfg, how)
    return (
        joined.withColumns(
            {
                "earnings": F.when(F.col(cfg.distance) > 0, F.col(cfg.pay)),
                "trip_group": C.trip_group(F.col("pickup_group"), F.col("dropoff_group"), cfg),
                "date": day,
                "hour": F.hour(cfg.pickup),
                "day_of_week": C.day_of_week(day),
                "after_toll": day >= F.lit(cfg.intervention),
            }
        )
        .withColumns(
            {
                "earnings_per_engaged_hour": F.when(
                    F.col(cfg.shared) != "Y", F.try_divide("earnings", "trip_hours")
                ),
                "trip_group_coarse": C.coarse_group(F.col("trip_group"), cfg),
                "time_band": C.time_band(F.col("hour"), cfg),
            }
        )
    )


def analysed(raw: DataFrame, labels: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Raw trips to analysed trips: time columns, cleaning, analysis columns."""
    return add_columns(clean(add_trip_time(raw, cfg), cfg), labels, cfg)
