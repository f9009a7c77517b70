"""The study's inputs, derived from the order tables.

Line items play trips: the customer's and supplier's nations are the two zones,
and three calendar years play the years before and after the intervention. Orders
of other years are moved by three years, so every line item is a trip. The same
SQL text feeds Spark and the check engine; only three macros differ.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.sources import files

STUDY = StudyConfig(
    service="lines",
    timezone="UTC",
    first_month=date(1998, 1, 1),
    last_month=date(2000, 12, 1),
    intervention=date(2000, 1, 5),
    placebo=date(1999, 1, 5),
    vendor="vendor",
    fee="zone_fee",
    seed_zones=(0, 1, 2, 3),
    unknown_zones=(23, 24),
    holidays=tuple(
        date(year, month, day)
        for year in (1998, 1999, 2000)
        for month, day in ((1, 1), (7, 4), (12, 25))
    ),
    # The order tables hold a few pickups a day and zone
    min_daily_pickups=0.3,
    exact_medians=True,
)

_SPARK = {
    "TS": "timestamp_ntz",
    "ADD": "timestampadd(SECOND, cast({n} as int), {t})",
    "MONTHS": "timestampadd(MONTH, {n}, {t})",
    # Orders meet their customers before the many more line items move
    "ORDERS": """(select o_orderkey, o_orderdate, c_nationkey
      from orders join customer on c_custkey = o_custkey) c on c.o_orderkey = l_orderkey""",
    "o": "c",
}
_DUCKDB = {
    "TS": "timestamp",
    "ADD": "({t} + to_seconds(cast({n} as bigint)))",
    "MONTHS": "({t} + to_months({n}))",
    "ORDERS": """orders o on o_orderkey = l_orderkey
    join customer c on c_custkey = o_custkey""",
    "o": "o",
}


def _trips_sql(dialect: dict[str, str]) -> str:
    ts, o = dialect["TS"], dialect["o"]

    def add(t: str, n: str) -> str:
        return dialect["ADD"].format(t=t, n=n)

    def moved(n: int) -> str:
        return dialect["MONTHS"].format(t=f"{o}.o_orderdate", n=n)

    shift = "case when l_orderkey % 1009 = 0 then 2764800 else 0 end"
    return f"""
  with b as (
    select l.*, c.c_nationkey, s.s_nationkey,
      case when {o}.o_orderdate < {ts} '1998-01-01 00:00:00' then {moved(36)}
        when {o}.o_orderdate < {ts} '2001-01-01 00:00:00' then {o}.o_orderdate
        else {moved(-36)} end as o_orderdate,
      (l_orderkey*7919 + l_partkey*104729 + l_linenumber*31 + l_suppkey*613) % 86400 as sod,
      (l_partkey*37 + l_orderkey) % 900 - 30 as wait_s,
      case when l_partkey % 211 = 0 then 18000 else 0 end
        + (cast(l_quantity as bigint)*97 + l_partkey*53) % 5400 - 20 as dur
    from lineitem l join {dialect["ORDERS"]} join supplier s on s_suppkey = l_suppkey),
  p as (select *, {add("o_orderdate", "sod")} as pickup_datetime from b)
  select case when l_returnflag = 'A' then 'V1' else 'V2' end as vendor,
    {add("pickup_datetime", "-wait_s")} as request_datetime, pickup_datetime,
    {add("pickup_datetime", "dur")} as dropoff_datetime,
    c_nationkey as PULocationID, s_nationkey as DOLocationID,
    case when l_orderkey % 97 = 0 or dur <= 0 then cast(0 as double)
         else cast(floor(dur * (8 + (l_suppkey*7 + l_orderkey) % 20)
                * (case when l_orderkey % 499 = 0 then 5 else 1 end)
                / cast(36 as double)) as double) / cast(100 as double) end as trip_miles,
    case when o_orderdate < {ts} '2000-01-05 00:00:00' then cast(null as double)
         when c_nationkey <= 3 or s_nationkey <= 3 or l_partkey % 16 = 0 then cast(1.5 as double)
         else cast(0 as double) end as zone_fee,
    case when l_discount = 0 and l_linenumber = 7 then cast(-1 as double)
         when l_partkey % 307 = 0 then cast(600 as double)
         else cast(5 as double)
              + cast(floor(l_extendedprice / cast(10 as double)) as double) / cast(100 as double)
         end as driver_pay,
    case when l_linenumber = 7 then 'Y' when l_linenumber = 6 and l_linestatus = 'O' then null
         else 'N' end as shared_match_flag,
    cast(date_trunc('month', {add("o_orderdate", shift)}) as date) as file_month
  from p"""


LABELS_SQL = """
  select n_nationkey as LocationID, n_name as Zone, n_nationkey <= 3 as in_cbd,
    case when n_nationkey <= 3 then 'cbd' when n_nationkey <= 9 then 'ring'
         when n_nationkey <= 22 then 'control' end as zone_group,
    case when n_nationkey <= 3 then 'cbd' when n_nationkey <= 6 then 'ring_adjacent'
         when n_nationkey <= 9 then 'ring_across' when n_nationkey <= 13 then 'control_near'
         when n_nationkey <= 22 then 'control_far' end as zone_group_fine
  from nation"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(spark: SparkSession, folder: str, sql: str, names: tuple[str, ...], **frames: DataFrame) -> DataFrame:
    for name in names:
        sql = sql.replace(f" {name} ", f" {{{name}}} ").replace(
            f"from {name}", f"from {{{name}}}"
        )
    frames = {name: table(spark, folder, name) for name in names} | frames
    return spark.sql(sql, **frames)


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """The trip-shaped view: one row a line item."""
    names = ("lineitem", "orders", "customer", "supplier")
    lines = files.read_by_key(spark, f"{folder}/lineitem.parquet", "l_orderkey")
    return _query(spark, folder, _trips_sql(_SPARK), names, lineitem=lines)


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Zone labels: the nations, of which two play the unknown zones."""
    return _query(spark, folder, LABELS_SQL, ("nation",))


def station(spark: SparkSession, folder: str, cfg: StudyConfig = STUDY) -> DataFrame:
    """A weather station's file: readings that follow each day's orders."""
    orders = table(spark, folder, "orders")
    daily = orders.groupBy(F.to_date("o_orderdate").alias("DATE")).agg(
        F.count("*").alias("n"), F.sum("o_custkey").alias("s")
    )
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(cfg.first_date), F.lit(cfg.last_date))).alias("DATE")
    )
    k = F.datediff("DATE", F.lit(cfg.first_date))
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0))
    warm = 10 + (k * 7 + n) % 21
    return days.join(daily, "DATE", "left").select(
        F.lit("S1").alias("STATION"),
        "DATE",
        (((n * 37 + k) % 50) / 10).alias("PRCP"),
        F.when(k % 97 != 0, (s % 7).cast("double")).alias("SNOW"),
        F.when(k % 89 != 0, (n % 11).cast("double")).alias("SNWD"),
        warm.cast("double").alias("TMAX"),
        (warm - 6 - k % 4).cast("double").alias("TMIN"),
    )


def area_speeds(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly speeds of three areas, over all months that have orders."""
    month = F.trunc(F.to_date("o_orderdate"), "month")
    return (
        table(spark, folder, "orders")
        .select(month.alias("month"), (F.col("o_custkey") % 3).alias("area"))
        .groupBy("month", "area")
        .agg((8 + F.count("*") % 5).cast("double").alias("zonal_speed"))
        .select("month", F.concat(F.lit("area_"), "area").alias("zone"), "zonal_speed")
    )


# Zone shapes: every customer owns a square parcel ----------------------------
PARCEL_SIDE = 100
SHAPES = replace(STUDY, ring_distance_ft=400.0, near_distance_ft=900.0)


def parcels(spark: SparkSession, folder: str) -> DataFrame:
    """One square a customer: zone id, name, corner and seed flag."""
    key = F.col("c_custkey")
    x, y = (key * 7919) % 20011, (key * 104729) % 20021
    seed = (F.col("c_nationkey") <= 3) & (x < 6000) & (y < 6000)
    return table(spark, folder, "customer").select(
        key.alias("zone_id"),
        F.col("c_mktsegment").alias("name"),
        x.cast("double").alias("x0"),
        y.cast("double").alias("y0"),
        seed.alias("is_seed"),
    )


def parcel_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """Corners of every parcel: zone id, ring, sequence, x, y."""
    side = PARCEL_SIDE
    corners = F.array(
        *[
            F.struct(
                F.lit(0).alias("ring"),
                F.lit(seq).alias("seq"),
                (F.col("x0") + dx).alias("x"),
                (F.col("y0") + dy).alias("y"),
            )
            for seq, (dx, dy) in enumerate([(0, 0), (side, 0), (side, side), (0, side)])
        ]
    )
    return parcels(spark, folder).select("zone_id", F.explode(corners).alias("v")).select(
        "zone_id", "v.*"
    )


def parcel_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return parcels(spark, folder).where("is_seed").select("zone_id")
