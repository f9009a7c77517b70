"""Checks on keys, nulls and totals. Each finds violations on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepchange.functions import columns as C


class DataQualityError(ValueError):
    """A table breaks an expectation the study rests on."""


def duplicate_keys(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return data.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def null_violations(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls in each required column: one row a column."""
    counts = data.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return counts.unpivot([], list(columns), "column", "nulls")


def flag_cardinality(data: DataFrame, flag: str, expected: int) -> DataFrame:
    """Rows with a flag set, against the number expected."""
    return data.agg(C.count_true(F.col(flag)).alias("flagged")).select(
        "flagged",
        F.lit(expected).cast("long").alias("expected"),
        (F.col("flagged") == expected).alias("ok"),
    )


def reconcile_totals(cube: DataFrame, facts: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Trips in the cube, in the facts and in the cleaned trips: all must agree."""
    parts = [
        cube.agg(F.sum("trips").alias("trips")).select(F.lit("cube").alias("source"), "trips"),
        facts.agg(F.sum("trips").alias("trips")).select(F.lit("facts").alias("source"), "trips"),
        cleaned.agg(F.count("*").alias("trips")).select(F.lit("cleaned").alias("source"), "trips"),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (
        stacked.groupBy()
        .pivot("source", ["cube", "facts", "cleaned"])
        .agg(F.first("trips"))
        .withColumn(
            "ok", (F.col("cube") == F.col("facts")) & (F.col("facts") == F.col("cleaned"))
        )
    )


def shared_names(zones: DataFrame, name: str = "Zone", key: str = "LocationID") -> DataFrame:
    """Names that more than one zone id carries, with the ids that share them."""
    repeated = (
        zones.groupBy(name)
        .agg(F.count("*").alias("zones"))
        .where(F.col("zones") > 1)
    )
    return zones.select(key, name).join(repeated, name).select(key, name, "zones")


def require_unique(data: DataFrame, keys: Sequence[str], name: str) -> None:
    """Raise if a key repeats. One example comes back, never the whole list."""
    example = duplicate_keys(data, keys).first()
    if example is not None:
        raise DataQualityError(f"{name}: {keys} repeats, for example {example.asDict()}")


def require_complete(data: DataFrame, columns: Sequence[str], name: str) -> None:
    """Raise if a required column holds a null."""
    bad = null_violations(data, columns).where("nulls > 0").collect()
    if bad:
        listed = ", ".join(f"{row['column']} ({row['nulls']})" for row in bad)
        raise DataQualityError(f"{name}: nulls in {listed}")
