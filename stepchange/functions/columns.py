"""Column expressions: times, bands, groups, periods, changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepchange.config import StudyConfig


def seconds_between(start: Column, end: Column, timezone: str) -> Column:
    """Seconds between two wall-clock times, measured between real instants.

    A trip over a daylight-saving change gets its true length, whatever the
    session time zone is.
    """
    if timezone == "UTC":
        return F.timestamp_diff("SECOND", start, end)
    zone, utc = F.lit(timezone), F.lit("UTC")
    return F.timestamp_diff(
        "SECOND",
        F.convert_timezone(zone, utc, start),
        F.convert_timezone(zone, utc, end),
    )


def is_true(condition: Column) -> Column:
    """A condition with null counted as false."""
    return F.coalesce(condition, F.lit(False))


def first_match(cases: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first case that holds (a CASE expression)."""
    chain = F
    for condition, value in cases:
        chain = chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def time_band(hour: Column, cfg: StudyConfig) -> Column:
    """Name of the band an hour falls in; a band may wrap past midnight."""
    return first_match(
        (
            ((hour >= start) | (hour < end)) if start > end else ((hour >= start) & (hour < end)),
            name,
        )
        for name, start, end in cfg.bands
    )


def band_order(band: Column, cfg: StudyConfig) -> Column:
    """Position of a band in the study's order, for sorting."""
    return F.array_position(F.array(*map(F.lit, cfg.band_names)), band).cast("int")


def trip_group(origin: Column, destination: Column, cfg: StudyConfig) -> Column:
    """Trip group: the first zone group, in priority order, that either end is in."""
    return first_match(
        ((origin == group) | (destination == group), name) for group, name in cfg.trip_groups
    )


def coarse_group(group: Column, cfg: StudyConfig) -> Column:
    """Treated, ring or control, from a fine trip group."""
    pairs = [F.lit(text) for pair in cfg.coarse_groups for text in pair]
    return F.element_at(F.create_map(*pairs), group)


def coarse_pickup_group(group: Column) -> Column:
    """Seed area, ring or control, from a fine zone group; null elsewhere."""
    return first_match(
        [
            (group == "cbd", "cbd"),
            (group.startswith("ring"), "ring"),
            (group.startswith("control"), "control"),
        ]
    )


def audit_group(origin: Column, destination: Column) -> Column:
    """Trip group of an uncleaned row from coarse zone groups that may be null."""
    return first_match(
        [
            ((origin == "cbd") | (destination == "cbd"), "treated"),
            ((origin == "ring") | (destination == "ring"), "ring"),
            ((origin == "control") & (destination == "control"), "control"),
        ],
        "unknown_zone",
    )


def period(day: Column, cfg: StudyConfig) -> Column:
    """``before``, ``after`` or null."""
    return first_match(
        (day.between(F.lit(start), F.lit(end)), name) for name, (start, end) in cfg.periods.items()
    )


def day_of_week(day: Column) -> Column:
    """Day of week with Monday as 1."""
    return F.weekday(day) + 1


def pct_change(before: Column, after: Column) -> Column:
    """Percent change, null unless ``before`` is positive."""
    return F.when(before > 0, (F.try_divide(after, before) - 1) * 100)


def ratio(top: Column, bottom: Column) -> Column:
    """Double division that gives null, not an error, on a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def log_change_pct(log_change: Column) -> Column:
    """A log change as a percentage."""
    return F.expm1(log_change) * 100


def exact_sum(column: Column | str, scale: int = 4) -> Column:
    """Sum money in decimals, so totals don't depend on the order of addition."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast(f"decimal(18,{scale})")).cast("double")


def count_true(condition: Column) -> Column:
    """Rows where a condition holds; 0 rather than null for an empty group."""
    return F.count_if(is_true(condition))


def round_all(frame, columns: Iterable[str], digits: int = 6):
    """Round several columns of a result table."""
    return frame.withColumns({name: F.round(name, digits) for name in columns})
