"""Monthly trip files whose schema drifts, read into one schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepchange.config import StudyConfig


def conform(raw: DataFrame, cfg: StudyConfig, file_month: date | Column) -> DataFrame:
    """Keep the study's columns with their declared types.

    Names match in any case, missing columns become typed nulls. The cast is
    left out where the file already has the type, so filters still reach the
    parquet reader.
    """
    present = {field.name.lower(): field for field in raw.schema.fields}
    selected = []
    for name, wanted in cfg.columns.items():
        field = present.get(name.lower())
        if field is None:
            column = F.lit(None).cast(wanted)
        elif field.dataType.simpleString() == wanted:
            column = F.col(f"`{field.name}`")
        else:
            column = F.col(f"`{field.name}`").cast(wanted)
        selected.append(column.alias(name))
    month = file_month if isinstance(file_month, Column) else F.lit(file_month)
    return raw.select(*selected, month.cast("date").alias("file_month"))


def read_month(spark: SparkSession, path: str, cfg: StudyConfig, month: date) -> DataFrame:
    """One month's parquet file(s) in the study's schema."""
    return conform(spark.read.parquet(path), cfg, month)


def read_months(spark: SparkSession, paths: Mapping[date, str], cfg: StudyConfig) -> DataFrame:
    """Every month stacked by name. Filters on ``file_month`` prune whole files."""
    return stack(read_month(spark, path, cfg, month) for month, path in paths.items())


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name."""
    return reduce(DataFrame.unionByName, frames)


def keyed_union(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Stack result tables, with their names in a key column."""
    return stack(
        frame.select(F.lit(name).alias(key), *frame.columns) for name, frame in frames.items()
    )


def month_starts(first: date, last: date) -> list[date]:
    """First days of the months of a closed range."""
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    index = [first.month - 1 + step for step in range(count)]
    return [date(first.year + i // 12, i % 12 + 1, 1) for i in index]


def month_spine(data: DataFrame, column: str) -> DataFrame:
    """Every month between the first and last date of a table, gaps included."""
    first_of_month = F.trunc(F.to_date(column), "month")
    ends = data.agg(
        F.min(first_of_month).alias("first"),
        F.max(first_of_month).alias("last"),
    )
    months = F.sequence("first", "last", F.expr("interval 1 month"))
    return ends.select(F.explode(months).alias("month")).withColumn(
        "days", F.day(F.last_day("month"))
    )
