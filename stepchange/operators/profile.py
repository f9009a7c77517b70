"""Profiles of the raw and cleaned trips: nulls, fees, histograms, quantiles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepchange.config import StudyConfig
from stepchange.functions import columns as C


def null_counts(data: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Nulls in every kept column, by file month and vendor."""
    keys = ["file_month", cfg.vendor]
    counted = [name for name in cfg.columns if name not in keys]
    return (
        data.groupBy(*keys)
        .agg(
            F.count("*").alias("rows"),
            *[F.count_if(F.col(name).isNull()).alias(name) for name in counted],
        )
        .orderBy(*keys)
    )


def _columns_with_nulls(totals: DataFrame, counted: Sequence[str]) -> list[str]:
    """Columns with any null: one row of flags comes back."""
    flags = totals.agg(*[F.max(F.col(name) > 0).alias(name) for name in counted]).first()
    return [name for name in counted if flags[name]]


def nulls_by_year(nulls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null counts by year, without the columns that have none.

    ``null_pct`` is the share of rows with a null in the worst column.
    """
    counted = [name for name in nulls.columns if name not in {"file_month", "rows", *keys}]
    totals = nulls.groupBy(F.year("file_month").alias("year"), *keys).agg(
        *[F.sum(name).alias(name) for name in ["rows", *counted]]
    )
    kept = _columns_with_nulls(totals, counted)
    table = totals.select("year", *keys, "rows", *kept)
    if not kept:
        return table
    worst = F.greatest(*kept) if len(kept) > 1 else F.col(kept[0])
    return table.withColumn("null_pct", F.round(C.ratio(worst, F.col("rows")) * 100, 2))


def null_shares(nulls: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Percent of rows with a null, by year, for the columns that have any."""
    counted = [name for name in nulls.columns if name not in {"file_month", "rows", cfg.vendor}]
    totals = nulls.groupBy(F.year("file_month").alias("year")).agg(
        *[F.sum(name).alias(name) for name in ["rows", *counted]]
    )
    kept = _columns_with_nulls(totals, counted)
    return totals.select(
        "year", *[(C.ratio(F.col(name), F.col("rows")) * 100).alias(name) for name in kept]
    )


def hourly_shares(data: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Percent of weekday and of weekend trips that start in each hour."""
    weekend = F.weekday(F.to_date(cfg.pickup)) >= 5
    counts = data.groupBy(
        F.hour(cfg.pickup).alias("hour"),
        F.when(weekend, "weekend").otherwise("weekday").alias("day"),
    ).count()
    share = C.ratio(F.col("count"), F.sum("count").over(W.partitionBy("day"))) * 100
    return (
        counts.withColumn("share", share)
        .groupBy("hour")
        .pivot("day", ["weekday", "weekend"])
        .agg(F.first("share"))
    )


def fee_values(data: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Fee values of the intervention year: trips, share, pickup hours seen.

    Counted by fee and hour first, so a single dominant fee is spread over its
    hours and the distinct count runs on the counts.
    """
    by_hour = (
        data.where(F.year("file_month") == cfg.intervention.year)
        .groupBy(F.round(cfg.fee, 2).alias("fee"), F.hour(cfg.pickup).alias("hour"))
        .agg(F.count("*").alias("n"))
        .where(F.col("fee").isNotNull())
    )
    fees = by_hour.groupBy("fee").agg(
        F.sum("n").alias("trips"), F.count("hour").alias("hours")
    )
    # One row per fee value: the total over them is a small window
    total = F.sum("trips").over(W.partitionBy(F.lit(0)))
    return fees.select(
        "fee",
        "trips",
        F.round(C.ratio(F.col("trips"), total) * 100, 3).alias("trips_pct"),
        "hours",
    )


def fee_vs_rule(data: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Charged trips against trips the zone rule calls treated, by month."""
    charged = F.coalesce(cfg.fee, F.lit(0.0)) > 0
    treated = F.col(cfg.origin).isin(*cfg.seed_zones) | F.col(cfg.destination).isin(
        *cfg.seed_zones
    )
    counts = (
        data.where(F.year("file_month") == cfg.intervention.year)
        .groupBy(F.month("file_month").alias("month"))
        .agg(
            C.count_true(charged).alias("charged"),
            C.count_true(treated).alias("treated"),
            C.count_true(charged & treated).alias("both"),
        )
    )
    return counts.select(
        "month",
        "charged",
        "treated",
        (C.ratio(F.col("both"), F.col("charged")) * 100).alias("treated_of_charged_pct"),
        (C.ratio(F.col("both"), F.col("treated")) * 100).alias("charged_of_treated_pct"),
    )


def earnings_coverage(trips: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Percent of trips with known engaged-hour earnings, years by coarse group."""
    known = C.ratio(F.count("earnings_per_engaged_hour"), F.count("*")) * 100
    return (
        trips.groupBy(F.year("date").alias("year"), "trip_group_coarse")
        .agg(known.alias("known_pct"))
        .groupBy("year")
        .pivot("trip_group_coarse", cfg.coarse_names)
        .agg(F.first("known_pct"))
    )


def add_money_columns(data: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Columns the histograms bin: minutes, money and money per hour."""
    return data.withColumns(
        {
            "trip_minutes": F.col("trip_seconds") / 60,
            "money": F.col(cfg.pay),
            "money_per_hour": F.try_divide(F.col(cfg.pay), F.col("trip_hours")),
        }
    )


def _bin_count(start: float, stop: float, width: float) -> int:
    return round((stop - start) / width)


def _bin_index(column: str, start: float, stop: float, width: float) -> Column:
    """Bin of a value, with values outside the range in the end bins."""
    raw = F.floor((F.col(column) - F.lit(start)) / F.lit(width))
    last = _bin_count(start, stop, width) - 1
    return F.least(F.greatest(raw, F.lit(0)), F.lit(last)).cast("int")


def histograms(
    data: DataFrame, specs: Iterable[tuple], keys: Sequence[str] = ()
) -> DataFrame:
    """Bin counts of many columns in one scan, empty bins filled with 0.

    ``specs`` are (column, start, stop, width). Nulls are skipped. Each row
    becomes one small struct a column, and partial counts shrink them to at
    most one row a bin before the shuffle.
    """
    specs = list(specs)
    entries = F.array(
        *[
            F.when(
                F.col(column).isNotNull(),
                F.struct(
                    F.lit(column).alias("column"),
                    _bin_index(column, start, stop, width).alias("bin"),
                ),
            )
            for column, start, stop, width in specs
        ]
    )
    counts = (
        data.select(*keys, F.explode(entries).alias("entry"))
        .where(F.col("entry").isNotNull())
        .groupBy(*keys, "entry.column", "entry.bin")
        .agg(F.count("*").alias("n"))
    )
    # Every bin of every spec, built from the specs alone
    layout = F.array(
        *[
            F.struct(
                F.lit(column).alias("column"),
                F.sequence(F.lit(0), F.lit(_bin_count(start, stop, width) - 1)).alias("bins"),
                F.lit(float(start)).alias("start"),
                F.lit(float(width)).alias("width"),
            )
            for column, start, stop, width in specs
        ]
    )
    groups = counts.select(*keys).distinct() if keys else data.sparkSession.range(1).select()
    spine = (
        groups.select(*keys, F.explode(layout).alias("spec"))
        .select(*keys, "spec.column", "spec.start", "spec.width", F.explode("spec.bins").alias("bin"))
    )
    on = [*keys, "column", "bin"]
    return spine.join(counts, on, "left").select(
        *keys,
        "column",
        "bin",
        (F.col("start") + F.col("bin") * F.col("width")).alias("left"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def histogram(data: DataFrame, column: str, start: float, stop: float, width: float) -> DataFrame:
    """Bin counts of one column."""
    return histograms(data, [(column, start, stop, width)]).drop("column")


def distribution_quantiles(data: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Quantiles read off fine histograms, one scan for every column.

    A value is its bin's upper edge, so it is right to one bin width; the end
    bins show as ``<edge`` and ``edge+``.
    """
    usable = data.where((F.col("trip_seconds") > 0) & (F.col(cfg.distance) > 0)).withColumn(
        "trip_minutes", F.col("trip_seconds") / 60
    )
    counts = histograms(usable, cfg.quantile_specs)
    running = W.partitionBy("column").orderBy("bin")
    share = C.ratio(
        F.sum("count").over(running.rowsBetween(W.unboundedPreceding, W.currentRow)),
        F.sum("count").over(W.partitionBy("column")),
    )
    probs = F.explode(F.array(*map(F.lit, cfg.quantile_probs))).alias("quantile")
    firsts = (
        counts.withColumn("share", share)
        .select("*", probs)
        .where(F.col("share") >= F.col("quantile"))
        .groupBy("column", "quantile")
        .agg(F.min("bin").alias("bin"))
    )
    labels = [
        (
            F.col("column") == column,
            F.when(F.col("bin") == _bin_count(start, stop, width) - 1, f"{stop}+")
            .when(F.col("bin") == 0, f"<{start + width}")
            .otherwise(
                F.round(F.lit(float(start)) + F.col("bin") * width + width, 2).cast("string")
            ),
        )
        for column, start, stop, width in cfg.quantile_specs
    ]
    return (
        firsts.withColumn("value", C.first_match(labels))
        .groupBy("quantile")
        .pivot("column", [spec[0] for spec in cfg.quantile_specs])
        .agg(F.first("value"))
    )


def stage_histograms(raw: DataFrame, cleaned: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Histograms before and after cleaning, as one job with a stage column."""
    used = [spec[0] for spec in cfg.histogram_specs]
    stages = [
        add_money_columns(frame, cfg).select(F.lit(stage).alias("stage"), *used)
        for stage, frame in (("raw", raw), ("cleaned", cleaned))
    ]
    return histograms(stages[0].unionByName(stages[1]), cfg.histogram_specs, ["stage"])


def staged_histograms(staged: DataFrame, passed: Column, cfg: StudyConfig) -> DataFrame:
    """The same from one scan: rows are counted by whether they pass, raw is both."""
    used = [spec[0] for spec in cfg.histogram_specs]
    rows = add_money_columns(staged, cfg).select(C.is_true(passed).alias("is_clean"), *used)
    counts = histograms(rows, cfg.histogram_specs, ["is_clean"])
    stages = F.explode(
        F.array_compact(F.array(F.lit("raw"), F.when(F.col("is_clean"), F.lit("cleaned"))))
    )
    return (
        counts.select("*", stages.alias("stage"))
        .groupBy("stage", "column", "bin", "left")
        .agg(F.sum("count").alias("count"))
    )


def end_bin_share(counts: DataFrame, column: str) -> DataFrame:
    """Percent of a histogram in its first and in its last bin, by stage."""
    total = F.sum("count")
    return (
        counts.where(F.col("column") == column)
        .groupBy("stage")
        .agg(
            (C.ratio(F.min_by("count", "bin"), total) * 100).alias("first_bin_pct"),
            (C.ratio(F.max_by("count", "bin"), total) * 100).alias("last_bin_pct"),
        )
    )
