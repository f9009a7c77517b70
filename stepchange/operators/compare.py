"""Before-and-after tables from the cube and from analysed trips."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepchange.config import StudyConfig
from stepchange.functions import columns as C
from stepchange.functions.quantiles import group_quantiles


def add_period(table: DataFrame, cfg: StudyConfig, column: str = "date") -> DataFrame:
    """Add ``period``: before, after or null."""
    return table.withColumn("period", C.period(F.col(column), cfg))


def _in(period: str) -> Column:
    return F.col("period") == period


def _before_after(measure: str) -> list[Column]:
    return [F.sum(F.when(_in(name), F.col(measure))).alias(name) for name in ("before", "after")]


def group_change(cube: DataFrame, by: Sequence[str], cfg: StudyConfig) -> DataFrame:
    """Trips before and after, and the percent change, by service and ``by``."""
    return (
        add_period(cube, cfg)
        .where(F.col("period").isNotNull())
        .groupBy("service", *by)
        .agg(*_before_after("trips"))
        .withColumn("change_pct", C.pct_change(F.col("before"), F.col("after")))
    )


def _monthly(cube: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Trips by service and month, one column a coarse group."""
    return (
        cube.groupBy("service", F.trunc("date", "month").alias("month"))
        .pivot("trip_group_coarse", cfg.coarse_names)
        .agg(F.sum("trips"))
    )


def relative_trips(cube: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Monthly trips relative to control, with the base year's mean ratio as 100.

    The base is the mean of monthly ratios, not the ratio of the year's sums.
    """
    base_year = cfg.intervention.year - 1
    service = W.partitionBy("service")
    groups = [name for name in cfg.coarse_names if name != "control"]
    ratios = _monthly(cube, cfg).select(
        "service", "month", *[C.ratio(F.col(g), F.col("control")).alias(g) for g in groups]
    )
    in_base = F.year("month") == base_year
    return ratios.select(
        "service",
        "month",
        *[
            (F.col(g) / F.avg(F.when(in_base, F.col(g))).over(service) * 100).alias(g)
            for g in groups
        ],
    )


def index_by_year(relative: DataFrame) -> DataFrame:
    """Mean of the monthly index by year."""
    return relative.groupBy("service", F.year("month").alias("year")).agg(
        F.avg("treated").alias("treated"), F.avg("ring").alias("ring")
    )


def monthly_ratio(relative: DataFrame, cfg: StudyConfig, group: str = "treated") -> DataFrame:
    """One group's index laid out as month of year by year."""
    return (
        relative.where(F.col("service") == cfg.service)
        .withColumn("year", F.year("month"))
        .groupBy(F.month("month").alias("month_of_year"))
        .pivot("year", cfg.years)
        .agg(F.avg(group))
    )


def same_month_diff(relative: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Change of a monthly value from the same month of the year before."""
    same_month = W.partitionBy(*keys, "month_of_year").orderBy("year")
    return (
        relative.select(
            *keys,
            F.month("month").alias("month_of_year"),
            F.year("month").alias("year"),
            F.col(value).alias("value"),
        )
        .withColumn("difference", F.col("value") - F.lag("value").over(same_month))
        .where(F.col("difference").isNotNull())
    )


def year_spread(differences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least, mean and greatest same-month difference of each year."""
    return differences.groupBy(*keys, "year").agg(
        F.min("difference").alias("min"),
        F.avg("difference").alias("mean"),
        F.max("difference").alias("max"),
    )


def month_to_month(
    relative: DataFrame, start: int, end: int, value: str = "treated"
) -> DataFrame:
    """Change between two months of every year, such as October to December."""
    month = F.month("month")
    picked = [F.max(F.when(month == number, F.col(value))) for number in (start, end)]
    return relative.groupBy("service", F.year("month").alias("year")).agg(
        (picked[1] - picked[0]).alias("change")
    )


def trips_per_day(cube: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Trips a day by month and coarse group, and the change over 12 rows.

    The lag is positional over the months present. One row a month by then.
    """
    month = F.trunc("date", "month").alias("month")
    # Distinct days are counted after reducing to one row a day
    days = (
        cube.select("service", "date")
        .distinct()
        .groupBy("service", month)
        .agg(F.count("*").alias("days"))
    )
    per_day = _monthly(cube, cfg).join(days, ["service", "month"])
    names = cfg.coarse_names
    per_day = per_day.select(
        "service", "month", *[C.ratio(F.col(g), F.col("days")).alias(g) for g in names]
    )
    in_order = W.partitionBy("service").orderBy("month")
    return per_day.select(
        "*",
        *[
            C.pct_change(F.lag(g, 12).over(in_order), F.col(g)).alias(f"{g}_change_pct")
            for g in names
        ],
    )


def zone_medians(trips: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Trips and median engaged-hour pay by origin zone and period."""
    keys = [cfg.origin, "period"]
    rows = add_period(trips, cfg).where(F.col("period").isNotNull())
    medians = group_quantiles(
        rows,
        keys,
        {"median": F.col("earnings_per_engaged_hour")},
        [0.5],
        cfg,
        [F.count("*").alias("trips")],
    )
    return medians.select(
        *keys, "trips", F.col("median")[0].alias("median_earnings_per_engaged_hour")
    )


def zone_change(cube: DataFrame, medians: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Change in pickups and in engaged-hour pay by origin zone.

    Unknown zones are left out: they are not one place.
    """
    rows = (
        add_period(cube.where(~F.col(cfg.origin).isin(*cfg.unknown_zones)), cfg)
        .where(F.col("period").isNotNull())
        .groupBy("service", cfg.origin, "date", "period")
        .agg(F.sum("trips").alias("trips"))
    )
    # Days of the base period that are in the table: one number
    days = rows.where(_in("before")).select("date").distinct().agg(F.count("*").alias("days"))
    zones = rows.groupBy("service", cfg.origin).agg(*_before_after("trips"))
    zones = zones.withColumn("days", days.scalar())
    eph = medians.groupBy(cfg.origin).agg(
        *[
            F.max(F.when(_in(name), F.col("median_earnings_per_engaged_hour"))).alias(
                f"eph_{name}"
            )
            for name in ("before", "after")
        ]
    )
    daily = C.ratio(F.col("before"), F.col("days"))
    return zones.join(eph, cfg.origin, "left").select(
        "service",
        cfg.origin,
        "before",
        "after",
        C.pct_change(F.col("before"), F.col("after")).alias("change_pct"),
        daily.alias("daily_before"),
        (daily >= cfg.min_daily_pickups).alias("enough_trips"),
        "eph_before",
        "eph_after",
        C.pct_change(F.col("eph_before"), F.col("eph_after")).alias("eph_change_pct"),
    )


def zone_names(changes: DataFrame, labels: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Zone names and groups on a zone table."""
    names = labels.select(
        F.col("LocationID").alias(cfg.origin), "Zone", "zone_group", "zone_group_fine"
    )
    return changes.join(names, cfg.origin, "left")


def zone_map_table(changes: DataFrame, labels: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Every labelled zone with its change; zones without one are not shown."""
    zones = labels.where(F.col("zone_group").isNotNull()).select("LocationID", "Zone", "zone_group")
    values = changes.select(
        F.col(cfg.origin).alias("LocationID"), "change_pct", "eph_change_pct", "enough_trips"
    )
    return zones.join(values, "LocationID", "left").withColumn(
        "enough_trips", C.is_true(F.col("enough_trips"))
    )


def average_rank(value: str, group: str) -> Column:
    """Rank with ties at their mean position, as a window over one group."""
    window = W.partitionBy(group)
    ties = F.count("*").over(W.partitionBy(group, value))
    return F.rank().over(window.orderBy(value)) + (ties - 1) / 2


def zone_correlation(changes: DataFrame, labels: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Spearman correlation of the two changes, over all zones and by group.

    Works on one row a zone; the windows hold a zone vocabulary, not trips.
    """
    shown = (
        zone_names(changes, labels, cfg)
        .where("enough_trips")
        .dropna(subset=["change_pct", "eph_change_pct"])
        .select(
            F.explode(F.array(F.lit("all shown"), "zone_group")).alias("group"),
            "change_pct",
            "eph_change_pct",
        )
        .where(F.col("group").isNotNull())
    )
    ranked = shown.withColumn("rank_trips", average_rank("change_pct", "group")).withColumn(
        "rank_eph", average_rank("eph_change_pct", "group")
    )
    # Rank sums keep a constant group at null instead of a division by zero
    return ranked.groupBy("group").agg(
        F.count("*").alias("zones"),
        F.nanvl(F.corr("rank_trips", "rank_eph"), F.lit(None)).alias("spearman"),
    )


def band_day_change(cube: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Change by coarse group, time band and day of week."""
    return group_change(cube, ["trip_group_coarse", "time_band", "day_of_week"], cfg)


DAYS = list(range(1, 8))


def _day_columns(table: DataFrame, value: str) -> DataFrame:
    wide = table.groupBy("time_band").pivot("day_of_week", DAYS).agg(F.first(value))
    return wide.withColumnsRenamed({str(day): f"day_{day}" for day in DAYS})


def relative_change(
    changes: DataFrame, cfg: StudyConfig, group: str = "treated", base: str = "control"
) -> DataFrame:
    """How much more a group changed than the base, bands by days of week (%)."""

    def growth(name: str) -> Column:
        rows = F.col("trip_group_coarse") == name
        value = C.ratio(F.col("after"), F.col("before"))
        return F.max(F.when(rows, value))

    ratios = (
        changes.where(F.col("service") == cfg.service)
        .groupBy("time_band", "day_of_week")
        .agg(((F.try_divide(growth(group), growth(base)) - 1) * 100).alias("value"))
    )
    return _day_columns(ratios, "value")


def band_day_table(changes: DataFrame, cfg: StudyConfig, group: str) -> DataFrame:
    """One group's change, bands by days of week (%)."""
    rows = changes.where(
        (F.col("service") == cfg.service) & (F.col("trip_group_coarse") == group)
    )
    return _day_columns(rows, "change_pct")


def speed_change(speeds: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Mean area speed, over the months the later year has in both years."""
    later = cfg.intervention.year
    rows = speeds.withColumns({"year": F.year("month"), "month_number": F.month("month")})
    present = rows.where(F.col("year") == later).select("month_number").distinct()
    same = rows.where(F.col("year").isin(later - 1, later)).join(
        present, "month_number", "left_semi"
    )
    means = same.groupBy("zone").agg(
        F.avg(F.when(F.col("year") == later - 1, F.col("zonal_speed"))).alias("before_mph"),
        F.avg(F.when(F.col("year") == later, F.col("zonal_speed"))).alias("after_mph"),
    )
    return means.withColumn(
        "change_pct", C.pct_change(F.col("before_mph"), F.col("after_mph"))
    )


# Trip-level panels ----------------------------------------------------------


def engaged_hour(trips: DataFrame, cfg: StudyConfig) -> DataFrame:
    """What an engaged hour holds, by pickup group and period."""
    keys = ["pickup_group", "period"]
    rows = (
        add_period(trips, cfg)
        .withColumn("pickup_group", C.coarse_pickup_group(F.col("pickup_group")))
        .where(F.col("pickup_group").isNotNull() & F.col("period").isNotNull())
    )
    shared = C.is_true(F.col(cfg.shared) == "Y").cast("int")
    shares = {
        "trips": F.count("*"),
        "shared_pct": F.avg(shared) * 100,
        "eph_known_pct": C.ratio(F.count("earnings_per_engaged_hour"), F.count("*")) * 100,
    }
    measures = {
        "median_speed_mph": F.col("speed_mph"),
        "median_trip_miles": F.col(cfg.distance),
        "median_trip_minutes": F.col("trip_seconds") / 60,
        "median_earnings_per_engaged_hour": F.col("earnings_per_engaged_hour"),
    }
    counts = [value.alias(name) for name, value in shares.items()]
    table = group_quantiles(rows, keys, measures, [0.5], cfg, counts)
    return table.select(*keys, *shares, *[F.col(name)[0].alias(name) for name in measures])


def pickup_group_order(cfg: StudyConfig) -> list[tuple[str, str]]:
    return [(group, period) for group in ("cbd", "ring", "control") for period in cfg.periods]


def reindex(
    table: DataFrame, keys: Sequence[str], expected: Sequence[tuple], position: str = "position"
) -> DataFrame:
    """A table on an expected list of keys: fixed order, missing keys as nulls."""
    spark = table.sparkSession
    types = {field.name: field.dataType.simpleString() for field in table.schema}
    schema = ", ".join(f"`{key}` {types[key]}" for key in keys)
    index = spark.createDataFrame(
        [(*key, number) for number, key in enumerate(expected)], f"{schema}, {position} int"
    )
    return index.join(table, list(keys), "left")


def engaged_hour_change(panel: DataFrame) -> DataFrame:
    """Each measure of the panel before, after and the change between them."""
    measures = [name for name in panel.columns if name not in {"pickup_group", "period"}]
    long = panel.select(
        "pickup_group", "period", *[F.col(name).cast("double").alias(name) for name in measures]
    ).unpivot(["pickup_group", "period"], measures, "measure", "value")
    return (
        long.groupBy("measure", "pickup_group")
        .agg(*[F.max(F.when(_in(name), F.col("value"))).alias(name) for name in ("before", "after")])
        .withColumn("change_pct", C.pct_change(F.col("before"), F.col("after")))
    )


def pickup_wait(trips: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Wait from request to pickup by month and coarse group, in minutes.

    Pickups before their request are counted and then left out.
    """
    keys = ["month", "trip_group_coarse"]
    seconds = C.seconds_between(F.col(cfg.request), F.col(cfg.pickup), cfg.timezone)
    rows = trips.select(
        F.trunc("date", "month").alias("month"), "trip_group_coarse", (seconds / 60).alias("wait")
    )
    counts = [F.count("*").alias("trips"), C.count_true(F.col("wait") < 0).alias("negative")]
    usable = {"usable": F.when(F.col("wait") >= 0, F.col("wait"))}
    return (
        group_quantiles(rows, keys, usable, [0.5, 0.9], cfg, counts)
        .select(
            *keys,
            "trips",
            "negative",
            F.col("usable")[0].alias("median_wait_min"),
            F.col("usable")[1].alias("p90_wait_min"),
        )
        .orderBy(*keys)
    )


def wait_by_year(waits: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Yearly mean of the monthly waits, one column a group and measure."""
    return (
        waits.groupBy(F.year("month").alias("year"))
        .pivot("trip_group_coarse", cfg.coarse_names)
        .agg(
            F.avg("median_wait_min").alias("median_wait_min"),
            F.avg("p90_wait_min").alias("p90_wait_min"),
        )
    )


def median_before(trips: DataFrame, cfg: StudyConfig, group: str = "treated") -> DataFrame:
    """Median engaged-hour pay of one group in the base period: one row."""
    start, end = cfg.periods["before"]
    rows = trips.where(
        (F.col("trip_group") == group) & F.col("date").between(F.lit(start), F.lit(end))
    )
    found = group_quantiles(
        rows, ["trip_group"], {"median": F.col("earnings_per_engaged_hour")}, [0.5], cfg
    )
    return found.select("trip_group", F.col("median")[0].alias("median_eph"))


# Small tables ---------------------------------------------------------------


def crosstab_margins(data: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts of two columns with row and column totals.

    Grouped to one row a combination first, then the margins are added on that.
    """
    counts = data.groupBy(rows, columns).agg(F.count("*").alias("n"))
    label = {
        name: F.when(F.grouping(name) == 1, "Total").otherwise(F.col(name))
        for name in (rows, columns)
    }
    margins = counts.cube(rows, columns).agg(
        label[rows].alias("row"), label[columns].alias("column"), F.sum("n").alias("n")
    )
    return (
        margins.groupBy("row")
        .pivot("column", [*values, "Total"])
        .agg(F.sum("n"))
        .fillna(0)
        .withColumnRenamed("row", rows)
    )


def trips_by_year(cube: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Trips by service and trip group, one column a year."""
    return (
        cube.withColumn("year", F.year("date"))
        .groupBy("service", "trip_group")
        .pivot("year", cfg.years)
        .agg(F.sum("trips"))
    )


def row_shares(data: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Percent of rows where each condition holds."""
    return data.agg(
        *[
            (F.avg(C.is_true(condition).cast("int")) * 100).alias(name)
            for name, condition in conditions.items()
        ]
    )


STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of zone-level columns.

    One row a statistic. Meant for tables with one row a zone: quartiles are
    interpolated exactly.
    """
    long = data.select(*[F.col(name).cast("double").alias(name) for name in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    value = F.col("value")
    stats = long.groupBy("column").agg(
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.percentile(value, 0.25).alias("25%"),
        F.percentile(value, 0.5).alias("50%"),
        F.percentile(value, 0.75).alias("75%"),
        F.max(value).alias("max"),
    )
    return (
        stats.unpivot(["column"], [f"`{name}`" for name in STATISTICS], "statistic", "value")
        .groupBy("statistic")
        .pivot("column", list(columns))
        .agg(F.first("value"))
    )


def group_medians(data: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Medians of zone-level columns by group."""
    return data.groupBy(*keys).agg(*[F.median(name).alias(name) for name in columns])


def sign_counts(changes: DataFrame, group: str) -> DataFrame:
    """Zones of a fine group: shown, with fewer pickups, with higher pay."""
    return changes.where(F.col("enough_trips") & (F.col("zone_group_fine") == group)).agg(
        F.count("*").alias("zones"),
        C.count_true(F.col("change_pct") < 0).alias("fewer_pickups"),
        C.count_true(F.col("eph_change_pct") > 0).alias("higher_pay"),
    )


def extremes(data: DataFrame, column: str, tie_break: str, n: int = 10) -> DataFrame:
    """The n smallest and n largest rows by a column, ties by a second column.

    Two top-k plans: each task keeps n rows, so nothing is sorted as a whole.
    """
    known = data.where(F.col(column).isNotNull())
    falls = known.orderBy(F.col(column).asc(), tie_break).limit(n)
    rises = known.orderBy(F.col(column).desc(), tie_break).limit(n)
    return falls.withColumn("side", F.lit("smallest")).unionByName(
        rises.withColumn("side", F.lit("largest"))
    )


def busiest(totals: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Keys of the n largest totals, ties by key."""
    return totals.orderBy(F.col(value).desc(), key).limit(n).select(key)


def flag_busiest(totals: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Every key with a flag for the n largest totals."""
    top = busiest(totals, key, value, n).withColumn("shown", F.lit(True))
    return totals.join(top, key, "left").withColumn("shown", C.is_true(F.col("shown")))


def seeded_sample(data: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows, the same ones however the data is partitioned.

    Rows are taken by the md5 of the seed and their keys as text, joined by bars.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return data.orderBy(order, *keys).limit(n)
