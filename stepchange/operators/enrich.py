"""Daily covariates and their join onto the cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.operators.quality import require_complete, require_unique
from stepchange.sources.monthly import stack

# The station file's column names and its read schema ----------
STATION_SCHEMA = (
    "STATION string, DATE date, PRCP double, SNOW double, SNWD double, TMAX double, TMIN double"
)
STATION_NAMES = {
    "DATE": "date",
    "PRCP": "rain_mm",
    "SNOW": "snow_mm",
    "SNWD": "snow_depth_mm",
    "TMAX": "temp_max_c",
    "TMIN": "temp_min_c",
}
# End of fixed values --------------------------------------------------------


def daily_covariates(station: DataFrame, cfg: StudyConfig) -> DataFrame:
    """A station's daily weather: renamed, no snow as 0, one complete row a day."""
    weather = (
        station.withColumnsRenamed(STATION_NAMES)
        .fillna(0.0, subset=["snow_mm", "snow_depth_mm"])
        .select("date", *cfg.weather)
    )
    require_unique(weather, ["date"], "weather")
    require_complete(weather, list(cfg.weather), "weather")
    return weather


def read_station(spark, path: str) -> DataFrame:
    """A station CSV with a declared schema."""
    return spark.read.csv(path, header=True, schema=STATION_SCHEMA, enforceSchema=False)


def is_holiday(day: Column, cfg: StudyConfig) -> Column:
    """Whether a date is in the study's holiday list (tens of literals)."""
    if not cfg.holidays:
        return F.lit(False)
    return day.isin(*[F.lit(holiday) for holiday in cfg.holidays])


def add_holidays(table: DataFrame, cfg: StudyConfig, date_column: str = "date") -> DataFrame:
    return table.withColumn("is_holiday", is_holiday(F.col(date_column), cfg))


def join_weather(cube: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on the date: one weather row a day, so no row is added."""
    return cube.join(weather, "date", "left")


def model_table(cube: DataFrame, weather: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The cube with weather and the holiday flag: the table the models use."""
    joined = add_holidays(join_weather(cube, weather), cfg)
    return joined.select(*cube.columns, *cfg.weather, "is_holiday")


def join_shapes(cube: DataFrame, weather: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Rows and columns after each join, and rows that found no weather."""
    first = cfg.weather[0]
    with_weather = join_weather(cube, weather)
    full = add_holidays(with_weather, cfg)

    def shape(position: int, step: str, data: DataFrame, unmatched: Column) -> DataFrame:
        return data.agg(
            F.lit(position).alias("position"),
            F.lit(step).alias("step"),
            F.count("*").alias("rows"),
            F.lit(len(data.columns)).alias("columns"),
            F.count_if(unmatched).alias("unmatched"),
        )

    none = F.lit(False)
    return stack(
        [
            shape(0, "summary cube", cube, none),
            shape(1, "daily weather", with_weather, F.col(first).isNull()),
            shape(2, "holiday flag", full, F.col(first).isNull()),
        ]
    )
