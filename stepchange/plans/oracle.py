"""SQL for the check engine: the study's tables as common table expressions."""

from __future__ import annotations

from stepchange.plans.driver_tables import _DUCKDB, LABELS_SQL, STUDY, _trips_sql

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (needs, sql)


def sql(body: str, *needs: str) -> str:
    """A statement with the common table expressions it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTE[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    head = ",\n".join(f"{name} as ({CTE[name][1]})" for name in ordered)
    return f"with {head}\n{body}" if head else body


cte("trips", _trips_sql(_DUCKDB))
cte("labels", LABELS_SQL)
cte(
    "timed",
    """select *, date_diff('second', pickup_datetime, dropoff_datetime) as trip_seconds,
      date_diff('second', pickup_datetime, dropoff_datetime) / 3600 as trip_hours,
      trip_miles / nullif(date_diff('second', pickup_datetime, dropoff_datetime) / 3600, 0)
        as speed_mph
    from trips""",
    "trips",
)
RULES = [
    ("pickup_in_file_month", "cast(date_trunc('month', pickup_datetime) as date) = file_month"),
    ("dropoff_after_pickup", "trip_seconds > 0"),
    ("positive_driver_pay", "driver_pay > 0"),
    ("trip_length", "trip_seconds between 60 and 18000"),
    ("distance_cap", "trip_miles <= 100"),
    ("speed_cap", "speed_mph <= 60"),
    ("money_cap", "driver_pay <= 500"),
    (
        "known_zones",
        "(PULocationID not in (23, 24) and DOLocationID not in (23, 24))"
        " or (PULocationID in (23, 24) and DOLocationID <= 3)"
        " or (DOLocationID in (23, 24) and PULocationID <= 3)",
    ),
]
cte(
    "ruled",
    "select *, "
    + ", ".join(f"coalesce({keep}, false) as k_{name}" for name, keep in RULES)
    + " from timed",
    "timed",
)
cte(
    "cleaned",
    "select * from ruled where " + " and ".join(f"k_{name}" for name, _ in RULES),
    "ruled",
)

TRIP_GROUP = """case when pickup_group = 'cbd' or dropoff_group = 'cbd' then 'treated'
      when 'ring_adjacent' in (pickup_group, dropoff_group) then 'ring_adjacent'
      when 'ring_across' in (pickup_group, dropoff_group) then 'ring_across'
      when 'control_near' in (pickup_group, dropoff_group) then 'control_near'
      when 'control_far' in (pickup_group, dropoff_group) then 'control_far' end"""
COARSE = """case when trip_group like 'ring%' then 'ring'
      when trip_group like 'control%' then 'control' else trip_group end"""
BAND = """case when hour >= 21 or hour < 5 then 'overnight' when hour < 10 then 'morning_peak'
      when hour < 16 then 'midday' else 'evening' end"""
PERIOD = """case when date between date '1999-01-05' and date '1999-12-31' then 'before'
      when date between date '2000-01-05' and date '2000-12-31' then 'after' end"""


def pct(before: str, after: str) -> str:
    return f"case when {before} > 0 then ({after} / {before} - 1) * 100 end"


cte(
    "grouped",
    """select c.*, coalesce(p.zone_group_fine, 'unknown') as pickup_group,
      coalesce(d.zone_group_fine, 'unknown') as dropoff_group,
      case when trip_miles > 0 then driver_pay end as earnings,
      cast(pickup_datetime as date) as date, cast(hour(pickup_datetime) as int) as hour
    from cleaned c join labels p on c.PULocationID = p.LocationID
    join labels d on c.DOLocationID = d.LocationID""",
    "cleaned",
    "labels",
)
cte(
    "analysed",
    f"""select *, {COARSE} as trip_group_coarse, {PERIOD} as period from (
      select *, {TRIP_GROUP} as trip_group, {BAND} as time_band,
        cast(isodow(date) as int) as day_of_week, date >= date '2000-01-05' as after_toll,
        case when shared_match_flag <> 'Y' then earnings / trip_hours end
          as earnings_per_engaged_hour
      from grouped)""",
    "grouped",
)
cte(
    "facts",
    """select PULocationID, dropoff_group, date, time_band, count(*) as trips,
      count(earnings) as trips_with_earnings,
      cast(sum(cast(earnings as decimal(18,4))) as double) as total_earnings,
      quantile_disc(earnings_per_engaged_hour, 0.5) as median_earnings_per_engaged_hour
    from analysed group by all""",
    "analysed",
)
cte(
    "cells",
    """select LocationID as PULocationID, coalesce(zone_group_fine, 'unknown') as pickup_group,
      dropoff_group
    from labels cross join (select unnest(['cbd', 'ring_adjacent', 'ring_across', 'control_near',
      'control_far', 'unknown']) as dropoff_group)
    where (coalesce(zone_group_fine, 'unknown') <> 'unknown' and dropoff_group <> 'unknown')
      or coalesce(zone_group_fine, 'unknown') = 'cbd' or dropoff_group = 'cbd'""",
    "labels",
)
cte(
    "grid",
    """select 'lines' as service, * from cells
    cross join (select cast(unnest(generate_series(date '1998-01-01', date '2000-12-31',
      interval 1 day)) as date) as date)
    cross join (select unnest(['overnight', 'morning_peak', 'midday', 'evening']) as time_band)""",
    "cells",
)
cte(
    "cube",
    f"""select *, {COARSE} as trip_group_coarse from (
      select service, PULocationID, dropoff_group, date, time_band, pickup_group,
        coalesce(trips, 0) as trips, coalesce(trips_with_earnings, 0) as trips_with_earnings,
        coalesce(total_earnings, 0) as total_earnings, median_earnings_per_engaged_hour,
        {TRIP_GROUP} as trip_group, date >= date '2000-01-05' as after_toll,
        cast(isodow(date) as int) as day_of_week
      from grid left join facts using (PULocationID, dropoff_group, date, time_band))""",
    "grid",
    "facts",
)
cte(
    "station",
    """select date, (n * 37 + k) % 50 / 10 as PRCP,
      case when k % 97 <> 0 then cast(s % 7 as double) end as SNOW,
      case when k % 89 <> 0 then cast(n % 11 as double) end as SNWD,
      cast(10 + (k * 7 + n) % 21 as double) as TMAX,
      cast(10 + (k * 7 + n) % 21 - 6 - k % 4 as double) as TMIN
    from (select d.date, date_diff('day', date '1998-01-01', d.date) as k,
        coalesce(n, 0) as n, coalesce(s, 0) as s
      from (select cast(unnest(generate_series(date '1998-01-01', date '2000-12-31',
        interval 1 day)) as date) as date) d
      left join (select cast(o_orderdate as date) as date, count(*) as n,
        cast(sum(o_custkey) as bigint) as s from orders group by 1) o using (date))""",
)
cte(
    "weather",
    """select date, PRCP as rain_mm, coalesce(SNOW, 0) as snow_mm,
      coalesce(SNWD, 0) as snow_depth_mm, TMAX as temp_max_c, TMIN as temp_min_c
    from station""",
    "station",
)
HOLIDAY = "strftime({0}, '%m-%d') in ('01-01', '07-04', '12-25') and year({0}) between 1998 and 2000"
cte(
    "model",
    f"""select cube.*, rain_mm, snow_mm, snow_depth_mm, temp_max_c, temp_min_c,
      {HOLIDAY.format("date")} as is_holiday
    from cube left join weather using (date)""",
    "cube",
    "weather",
)
cte("periods", f"select *, {PERIOD} as period from cube", "cube")
cte(
    "medians",
    """select PULocationID, period, count(*) as trips,
      quantile_disc(earnings_per_engaged_hour, 0.5) as median_earnings_per_engaged_hour
    from analysed where period is not null group by all""",
    "analysed",
)
cte(
    "zchange",
    f"""select *, {pct("before", "after")} as change_pct, before / days as daily_before,
      before / days >= {STUDY.min_daily_pickups} as enough_trips,
      {pct("eph_before", "eph_after")} as eph_change_pct
    from (select service, PULocationID, cast(sum(trips) filter (period = 'before') as bigint) as before,
        cast(sum(trips) filter (period = 'after') as bigint) as after
      from periods where PULocationID not in (23, 24) and period is not null group by all)
    left join (select PULocationID,
        max(median_earnings_per_engaged_hour) filter (period = 'before') as eph_before,
        max(median_earnings_per_engaged_hour) filter (period = 'after') as eph_after
      from medians group by all) using (PULocationID)
    cross join (select count(distinct date) as days from periods where period = 'before')""",
    "periods",
    "medians",
)
cte(
    "named",
    """select z.*, l.Zone, l.zone_group, l.zone_group_fine
    from zchange z left join labels l on z.PULocationID = l.LocationID""",
    "zchange",
    "labels",
)
cte(
    "monthly",
    """select service, cast(date_trunc('month', date) as date) as month,
      cast(sum(trips) filter (trip_group_coarse = 'treated') as bigint) as treated,
      cast(sum(trips) filter (trip_group_coarse = 'ring') as bigint) as ring,
      cast(sum(trips) filter (trip_group_coarse = 'control') as bigint) as control,
      count(distinct date) as days
    from cube group by all""",
    "cube",
)
cte(
    "relative",
    """select service, month,
      t / avg(t) filter (year(month) = 1999) over (partition by service) * 100 as treated,
      r / avg(r) filter (year(month) = 1999) over (partition by service) * 100 as ring
    from (select *, treated / nullif(control, 0) as t, ring / nullif(control, 0) as r from monthly)""",
    "monthly",
)
cte(
    "gchange",
    f"""select *, {pct("before", "after")} as change_pct from (
      select service, trip_group_coarse, time_band, day_of_week,
        cast(sum(trips) filter (period = 'before') as bigint) as before,
        cast(sum(trips) filter (period = 'after') as bigint) as after
      from periods where period is not null group by all)""",
    "periods",
)
cte(
    "wait",
    """select cast(date_trunc('month', date) as date) as month, trip_group_coarse,
      count(*) as trips, count(*) filter (w < 0) as negative,
      quantile_disc(w, 0.5) filter (w >= 0) as median_wait_min,
      quantile_disc(w, 0.9) filter (w >= 0) as p90_wait_min
    from (select *, date_diff('second', request_datetime, pickup_datetime) / 60 as w from analysed)
    group by all""",
    "analysed",
)
# The 52-week baseline as the prediction for a test year
cte(
    "naive",
    """select PULocationID, dropoff_group, time_band, date, trip_group, trip_group_coarse, trips,
      total_earnings, max(trips) over earlier as naive_trips,
      max(total_earnings) over earlier as naive_total_earnings
    from cube window earlier as (partition by PULocationID, dropoff_group, time_band order by date
      range between interval 364 days preceding and interval 364 days preceding)""",
    "cube",
)
