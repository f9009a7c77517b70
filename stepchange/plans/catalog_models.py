"""Spatial and model queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from stepchange.operators import attribution, compare, did, quality, report, spatial
from stepchange.operators import forecast as forecasts
from stepchange.plans import catalog
from stepchange.plans import driver_tables as tables
from stepchange.plans.catalog import query, rounded
from stepchange.plans.driver_tables import PARCEL_SIDE, SHAPES, STUDY
from stepchange.plans.oracle import cte
from stepchange.sources import files, staged

# Zone shapes ----------------------------------------------------------------
cte(
    "parcels",
    """select *, c_nationkey <= 3 and x0 < 6000 and y0 < 6000 as is_seed from (
      select c_custkey as zone_id, c_mktsegment as name, c_nationkey,
        cast(c_custkey * 7919 % 20011 as double) as x0,
        cast(c_custkey * 104729 % 20021 as double) as y0 from customer)""",
)
# Distance of axis-parallel squares, which the general operator has to reproduce
cte(
    "parcel_labels",
    f"""select *, case when in_cbd then 'cbd' when d <= {SHAPES.ring_distance_ft} then 'ring'
        else 'control' end as zone_group,
      case when in_cbd then 'cbd'
        when d <= {SHAPES.ring_distance_ft} and d = 0 then 'ring_adjacent'
        when d <= {SHAPES.ring_distance_ft} then 'ring_across'
        when d <= {SHAPES.near_distance_ft} then 'control_near'
        else 'control_far' end as zone_group_fine
    from (select a.zone_id, a.name, a.is_seed as in_cbd,
        round(min(sqrt(greatest(abs(a.x0 - b.x0) - {PARCEL_SIDE}, 0) ** 2
          + greatest(abs(a.y0 - b.y0) - {PARCEL_SIDE}, 0) ** 2))) as d
      from parcels a cross join (select x0, y0 from parcels where is_seed) b group by all)""",
    "parcels",
)


@query(
    "zone_segments",
    f"""select zone_id, 0 as ring, seq::int as seq, x0 + {PARCEL_SIDE} * a as x1,
      y0 + {PARCEL_SIDE} * b as y1, x0 + {PARCEL_SIDE} * c as x2, y0 + {PARCEL_SIDE} * d as y2
    from parcels cross join (values (0, 0, 0, 1, 0), (1, 1, 0, 1, 1), (2, 1, 1, 0, 1),
      (3, 0, 1, 0, 0)) v(seq, a, b, c, d)""",
    "parcels",
)
def zone_segments(spark, folder):
    return spatial.zone_segments(tables.parcel_vertices(spark, folder))


def _parcel_labels(spark, folder):
    lookup = tables.parcels(spark, folder).select("zone_id", "name")
    return spatial.zone_labels(
        lookup,
        tables.parcel_vertices(spark, folder),
        tables.parcel_seeds(spark, folder),
        SHAPES,
    )


LABEL_COLUMNS = "zone_id, name, in_cbd, d as distance_to_seed_ft, zone_group, zone_group_fine"


@query("zone_labels", f"select {LABEL_COLUMNS} from parcel_labels", "parcel_labels")
def zone_labels(spark, folder):
    return _parcel_labels(spark, folder)


@query(
    "ring_zones_sorted",
    f"select {LABEL_COLUMNS} from parcel_labels where zone_group = 'ring'",
    "parcel_labels",
)
def ring_zones_sorted(spark, folder):
    ring = _parcel_labels(spark, folder).where(F.col("zone_group") == "ring")
    return ring.orderBy("distance_to_seed_ft", "zone_id")


@query(
    "zone_area",
    f"""select zone_id, {PARCEL_SIDE}::double * {PARCEL_SIDE} as area,
      round({PARCEL_SIDE}::double * {PARCEL_SIDE} / 27878400, 3) as area_sq_mi from parcels""",
    "parcels",
)
def zone_area(spark, folder):
    return rounded(spatial.zone_area(tables.parcel_vertices(spark, folder)))


@query(
    "zone_bbox",
    f"""select min(x0) - 500 as min_x, min(y0) - 300 as min_y, max(x0) + {PARCEL_SIDE} + 500 as max_x,
      max(y0) + {PARCEL_SIDE} + 300 as max_y
    from parcels join parcel_labels using (zone_id) where zone_group in ('cbd', 'ring')""",
    "parcels",
    "parcel_labels",
)
def zone_bbox(spark, folder):
    near = _parcel_labels(spark, folder).where(F.col("zone_group").isin("cbd", "ring"))
    return spatial.group_box(tables.parcel_vertices(spark, folder), near, 500, 300)


@query(
    "shared_names_area",
    f"""select zone_id, name, zones, round({PARCEL_SIDE}::double * {PARCEL_SIDE} / 27878400, 3)
      as area_sq_mi
    from parcels join (select name, count(*) as zones from parcels group by 1 having count(*) > 1)
      using (name)""",
    "parcels",
)
def shared_names_area(spark, folder):
    zones = quality.shared_names(tables.parcels(spark, folder), "name", "zone_id")
    areas = spatial.zone_area(tables.parcel_vertices(spark, folder))
    return zones.join(areas.select("zone_id", "area_sq_mi"), "zone_id")


# Difference-in-differences --------------------------------------------------


def _panel(spark, folder):
    return did.did_panel(catalog.model_table(spark, folder), STUDY)


DUMMIES = """(trip_group = 'treated')::int::double as treated,
      (trip_group = 'ring_adjacent')::int::double as ring_adjacent,
      (trip_group = 'ring_across')::int::double as ring_across,
      (trip_group_coarse = 'ring')::int::double as ring"""


@query(
    "did_panel",
    f"""select PULocationID, dropoff_group, time_band, date, trip_group, trips, trips_with_earnings,
      rain_mm, snow_mm, snow_depth_mm, temp_max_c, temp_min_c,
      PULocationID || '|' || dropoff_group || '|' || time_band as cell,
      strftime(date, '%Y-%m-%d') || '|' || time_band as date_band,
      round(date_diff('day', date '1998-01-01', date) / 365.25, 6) as trend,
      round(ln(median_earnings_per_engaged_hour), 6) as log_eph,
      {DUMMIES}, treated * (date >= date '2000-01-05')::int as treated_after,
      ring_adjacent * (date >= date '2000-01-05')::int as ring_adjacent_after,
      ring_across * (date >= date '2000-01-05')::int as ring_across_after,
      ring * (date >= date '2000-01-05')::int as ring_after
    from model""",
    "model",
)
def did_panel(spark, folder):
    return rounded(_panel(spark, folder))


@query(
    "after_terms",
    """select trip_group, date, count(*) as rows,
      cast(sum((trip_group = 'treated' and date >= date '1999-01-05')::int) as double)
        as treated_after,
      cast(sum((trip_group_coarse = 'ring' and date >= date '1999-01-05')::int) as double)
        as ring_after
    from cube group by all""",
    "cube",
)
def after_terms(spark, folder):
    panel = did.set_intervention(_panel(spark, folder), STUDY.placebo)
    return panel.groupBy("trip_group", "date").agg(
        F.count("*").alias("rows"),
        F.sum("treated_after").alias("treated_after"),
        F.sum("ring_after").alias("ring_after"),
    )


@query("did_poisson")
def did_poisson(spark, folder):
    return did.did_checks(_panel(spark, folder), STUDY, ["trips"], ["headline"])


@query("did_wls")
def did_wls(spark, folder):
    files.use_checkpoints(spark)
    return did.did_checks(_panel(spark, folder), STUDY, ["log_eph"], ["headline"])


@query("did_checks")
def did_checks(spark, folder):
    files.use_checkpoints(spark)
    return did.did_checks(_panel(spark, folder), STUDY)


@query("filtered_effects")
def filtered_effects(spark, folder):
    effects = did.did_checks(
        _panel(spark, folder), STUDY, ["trips"], ["headline", "pooled ring", "placebo"]
    )
    return effects.where("check in ('headline', 'placebo') and term = 'all'")


@query("event_study")
def event_study(spark, folder):
    return did.event_study(catalog.model_table(spark, folder), STUDY)


@query("event_yoy")
def event_yoy(spark, folder):
    events = did.event_study(catalog.model_table(spark, folder), STUDY)
    return compare.same_month_diff(events, ["group"], "effect_pct")


@query("effect_dollars")
def effect_dollars(spark, folder):
    files.use_checkpoints(spark)
    effects = did.did_checks(_panel(spark, folder), STUDY, ["log_eph"], ["headline"])
    median = compare.median_before(catalog.analysed(spark, folder), STUDY)
    return did.effect_dollars(effects, median)


# Forecast -------------------------------------------------------------------
cte(
    "naive_rows",
    """select *, trips::double as actual, naive_trips::double as predicted from naive
    where date >= date '2000-01-05'""",
    "naive",
)


def _naive_rows(cube, target="trips"):
    """The toll period with the 52-week baseline as its forecast."""
    rows = forecasts.seasonal_naive(cube, STUDY)
    return rows.where(F.col("date") >= F.lit(STUDY.intervention)).select(
        *STUDY.cell,
        "date",
        "trip_group",
        "trip_group_coarse",
        F.col(target).cast("double").alias("actual"),
        F.col(f"naive_{target}").cast("double").alias("predicted"),
    )


@query(
    "forecast_features",
    """select PULocationID, dropoff_group, time_band, date, trip_group, trip_group_coarse,
      day_of_week, cast(month(date) as int) as month, is_holiday::int as is_holiday, rain_mm,
      snow_mm, snow_depth_mm, temp_max_c, temp_min_c, cast(year(date) as int) as year,
      round(avg(trips) filter (year(date) < 2000)
        over (partition by PULocationID, dropoff_group, time_band), 6) as usual,
      trips::double as actual, year(date) < 2000 as is_train
    from model""",
    "model",
)
def forecast_features(spark, folder):
    train = F.year("date") < STUDY.intervention.year
    return rounded(
        forecasts.features(catalog.model_table(spark, folder), train, "trips", STUDY)
    )


def _scores(target: str) -> str:
    error = f"(naive_{target} - {target})"
    return f"""select '{target}' as target, '52-week baseline' as forecast,
      round(avg(abs({error})), 6) as mae, round(sqrt(avg({error} * {error})), 6) as rmse,
      round(sum(abs({error})) / sum({target}) * 100, 6) as wmape_pct
    from naive where year(date) = 1999"""


@query("baseline_scores", f"{_scores('trips')} union all {_scores('total_earnings')}", "naive")
def baseline_scores(spark, folder):
    return rounded(forecasts.baseline_scores(catalog.kept_cube(spark, folder), STUDY))


@query(
    "accuracy",
    """select trip_group, round(avg(abs(predicted - actual)), 6) as mae,
      round(sqrt(avg((predicted - actual) ** 2)), 6) as rmse,
      round(sum(abs(predicted - actual)) / sum(actual) * 100, 6) as wmape_pct
    from naive_rows group by 1""",
    "naive_rows",
)
def accuracy(spark, folder):
    rows = _naive_rows(catalog.cube(spark, folder))
    return rounded(forecasts.accuracy(rows, keys=["trip_group"]))


@query(
    "zone_errors",
    """select PULocationID, round(e / sum(e) over () * 100, 6) as abs_error_share_pct, trips,
      predicted, round((predicted / nullif(trips, 0) - 1) * 100, 6) as bias_pct,
      round((trips / nullif(b, 0) - 1) * 100, 6) as change_pct
    from (select PULocationID, sum(actual) as trips, sum(predicted) as predicted,
        sum(abs(predicted - actual)) as e from naive_rows group by 1)
    left join (select PULocationID, sum(trips) as b from cube where year(date) = 1999 group by 1)
      using (PULocationID)
    order by e desc, PULocationID limit 8""",
    "naive_rows",
    "cube",
)
def zone_errors(spark, folder):
    cube = catalog.kept_cube(spark, folder)
    year = STUDY.intervention.year
    return rounded(forecasts.zone_errors(_naive_rows(cube), cube, STUDY, year))


@query(
    "forecast_effect",
    """select time_band, trip_group_coarse, round((r - 1) * 100, 6) as gap_pct,
      round((r / c - 1) * 100, 6) as effect_pct
    from (select time_band, trip_group_coarse, sum(actual) / sum(predicted) as r
      from naive_rows group by all)
    join (select time_band, sum(actual) / sum(predicted) as c from naive_rows
      where trip_group_coarse = 'control' group by 1) using (time_band)""",
    "naive_rows",
)
def forecast_effect(spark, folder):
    rows = _naive_rows(catalog.cube(spark, folder))
    return rounded(forecasts.forecast_effect(rows, "trip_group_coarse", ["time_band"]))


cte(
    "gaps",
    """select * from (
      select a.PULocationID, time_band, a.at_ as trips,
        sum(a.at_) over (partition by a.PULocationID) as zone_trips,
        (a.at_ / nullif(a.pt, 0) - 1) * 100 as trips_gap_pct,
        (a.at_ / nullif(a.pt, 0) / (ct / cpt) - 1) * 100 as trips_effect_pct,
        (a.ae / nullif(a.pe, 0) - 1) * 100 as total_earnings_gap_pct,
        (a.ae / nullif(a.pe, 0) / (ce / cpe) - 1) * 100 as total_earnings_effect_pct
      from (select PULocationID, time_band, sum(trips)::double as at_,
          sum(naive_trips)::double as pt, sum(total_earnings) as ae,
          sum(naive_total_earnings) as pe from naive_rows group by all) a
      join (select time_band, sum(trips)::double as ct, sum(naive_trips)::double as cpt,
          sum(total_earnings) as ce, sum(naive_total_earnings) as cpe from naive_rows
        where trip_group_coarse = 'control' group by all) c using (time_band))""",
    "naive_rows",
)
cte(
    "named_gaps",
    """select g.PULocationID, l.Zone, l.zone_group, g.time_band, g.trips, g.zone_trips,
      dense_rank() over (order by g.zone_trips desc, g.PULocationID) <= 15 as shown,
      round(trips_gap_pct, 6) as trips_gap_pct, round(trips_effect_pct, 6) as trips_effect_pct,
      round(total_earnings_gap_pct, 6) as total_earnings_gap_pct,
      round(total_earnings_effect_pct, 6) as total_earnings_effect_pct
    from gaps g left join labels l on l.LocationID = g.PULocationID""",
    "gaps",
    "labels",
)


def _gaps(spark, folder):
    naive = forecasts.seasonal_naive(catalog.cube(spark, folder), STUDY).where(
        F.col("date") >= F.lit(STUDY.intervention)
    )
    targets = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(target).alias("target"),
                    F.col(target).cast("double").alias("actual"),
                    F.col(f"naive_{target}").cast("double").alias("predicted"),
                )
                for target in forecasts.TARGETS
            ]
        )
    ).alias("t")
    rows = naive.select(STUDY.origin, "time_band", "trip_group_coarse", targets).select(
        STUDY.origin, "time_band", "trip_group_coarse", "t.*"
    )
    return forecasts.zone_band_gaps(rows, tables.labels(spark, folder), STUDY)


@query("zone_band_gaps", "select * from named_gaps", "named_gaps")
def zone_band_gaps(spark, folder):
    return rounded(forecasts.sort_gaps(_gaps(spark, folder), STUDY))


@query(
    "gap_medians",
    """select zone_group, time_band, round(median(trips_gap_pct), 6) as trips_gap_pct,
      round(median(total_earnings_gap_pct), 6) as total_earnings_gap_pct
    from named_gaps where zone_group is not null group by all""",
    "named_gaps",
)
def gap_medians(spark, folder):
    gaps = rounded(_gaps(spark, folder)).where("zone_group is not null")
    return rounded(
        compare.group_medians(
            gaps, ["zone_group", "time_band"], ["trips_gap_pct", "total_earnings_gap_pct"]
        )
    )


@query(
    "shown_share",
    "select round(sum(trips) filter (shown) / sum(trips) * 100, 6) as shown_pct from named_gaps",
    "named_gaps",
)
def shown_share(spark, folder):
    return rounded(forecasts.shown_share(_gaps(spark, folder)))


HEATMAP = ("trips_gap_pct", "total_earnings_gap_pct")


@query(
    "heatmap_pivot",
    "select PULocationID, Zone, zone_trips, "
    + ", ".join(
        f"max({m}) filter (time_band = '{b}') as {b}_{m}" for b in STUDY.band_names for m in HEATMAP
    )
    + " from named_gaps group by all",
    "named_gaps",
)
def heatmap_pivot(spark, folder):
    return rounded(forecasts.heatmap_pivot(_gaps(spark, folder), HEATMAP, STUDY))


# The study's settings on whole tables; a fit serves all queries of a session
REGISTERED = forecasts.BoostParams()
_FITS: dict[tuple, object] = {}


def _fit(spark, folder, kind: str, target: str):
    """A fitted model and its forecasts: ``year`` is trained on the first year, ``toll`` on all before the toll."""
    paths = [f"{folder}/{name}.parquet" for name in catalog.TRIP_TABLES]
    key = (spark.sparkContext.applicationId, kind, target, staged.fingerprint(spark, paths))
    if key not in _FITS:
        table = catalog.kept_model_table(spark, folder)
        fit = forecasts.year_split if kind == "year" else forecasts.forecast
        _FITS[key] = fit(table, target, STUDY, REGISTERED)
    return _FITS[key]


def _fits(spark, folder, kind: str):
    """The fits of all targets, side by side: their steps are short jobs that leave cores free."""
    with ThreadPoolExecutor(len(forecasts.TARGETS)) as pool:
        found = pool.map(lambda target: _fit(spark, folder, kind, target), forecasts.TARGETS)
        return dict(zip(forecasts.TARGETS, found))


@query("boosted_forecast")
def boosted_forecast(spark, folder):
    model, _ = _fit(spark, folder, "toll", "trips")
    return rounded(forecasts.deviance(model.rows, "trips"))


@query("validate")
def validate(spark, folder):
    rows = {target: rows for target, (_, rows) in _fits(spark, folder, "year").items()}
    return rounded(forecasts.validation(catalog.kept_model_table(spark, folder), rows, STUDY))


@query("forecast_placebo")
def forecast_placebo(spark, folder):
    rows = {target: rows for target, (_, rows) in _fits(spark, folder, "year").items()}
    return rounded(forecasts.placebo_effects(rows))


@query("forecast")
def forecast(spark, folder):
    _, rows = _fit(spark, folder, "toll", "trips")
    return rounded(rows)


@query("shap_importance")
def shap_importance(spark, folder):
    model, _ = _fit(spark, folder, "toll", "trips")
    return rounded(attribution.shap_importance(model, STUDY))


@query("model_comparison")
def model_comparison(spark, folder):
    files.use_checkpoints(spark)
    table = catalog.kept_model_table(spark, folder)
    effects = did.did_checks(
        did.did_panel(table, STUDY), STUDY, checks=["headline", "by time band"]
    )
    rows = {target: rows for target, (_, rows) in _fits(spark, folder, "toll").items()}
    return rounded(report.comparison(effects, rows, STUDY))
