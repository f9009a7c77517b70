"""The stage table: raw trips with their first failed rule and analysis columns, stored once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.operators import trips

FAILED = trips.FAILED


def stage(raw: DataFrame, labels: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Every raw trip with time columns, the first rule it fails and analysis columns.

    ``failed_rule`` is the position of the first failed rule, or the number of
    rules. A zone without a label has a null group. No row is filtered, so a
    view's expressions stay out of join conditions: they are evaluated once.
    """
    timed = trips.add_trip_time(raw, cfg)
    failed = trips.first_failed_position(cfg)
    columns = [*timed.columns, FAILED]
    joined = trips.add_columns(timed.withColumn(FAILED, failed), labels, cfg, how="left")
    return joined.select(*columns, *[name for name in joined.columns if name not in columns])


def raw(staged: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The raw trips of a stage table."""
    return staged.select(*cfg.columns, "file_month")


def timed(staged: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Raw trips with their time columns and the first failed rule."""
    times = ["trip_seconds", "trip_hours", "speed_mph"]
    return staged.select(*cfg.columns, "file_month", *times, FAILED)


def passed(cfg: StudyConfig) -> Column:
    """Whether a staged trip passes every rule: one comparison, which reaches the files."""
    return F.col(FAILED) == len(trips.rules(cfg))


def cleaned(staged: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Trips that pass every rule, with time columns."""
    return timed(staged.where(passed(cfg)), cfg).drop(FAILED)


def analysed(staged: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Analysed trips: those that pass every rule and have both ends labelled."""
    known = F.col("pickup_group").isNotNull() & F.col("dropoff_group").isNotNull()
    return staged.where(passed(cfg) & known).drop(FAILED)


def fingerprint(spark: SparkSession, folders: list[str], salt: str = "") -> str:
    """A key of the files under some paths: names, sizes and times of change."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for folder in folders:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(conf).listFiles(place, True)
        while files.hasNext():
            entry = files.next()
            seen.append((entry.getPath().toString(), entry.getLen(), entry.getModificationTime()))
    return hashlib.sha256(repr((sorted(seen), salt)).encode()).hexdigest()[:32]


def write_months(table: DataFrame, path: str) -> None:
    """A table as parquet, a folder a month: a small month together, a large one in parts of the advisory size."""
    table.hint("rebalance", "file_month").write.partitionBy("file_month").parquet(path)


def write_whole(table: DataFrame, path: str) -> None:
    table.write.parquet(path)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Within this, no method of over 8000 bytes is made of a plan.

    HotSpot leaves such methods to its interpreter, which took two thirds of the
    time of the stage of trips.
    """
    name, limit = "spark.sql.codegen.hugeMethodLimit", "8000"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Stages:
    """Stored tables of a session, built at first use and again when an input's files change.

    Queries in several threads wait for a table that one of them builds.
    """

    def __init__(self) -> None:
        self._paths: dict[tuple, str] = {}
        self._building = RLock()

    def get(
        self,
        spark: SparkSession,
        name: str,
        inputs: list[str],
        build: Callable[[], DataFrame],
        root: Callable[[], str],
        write: Callable[[DataFrame, str], None] = write_whole,
    ) -> DataFrame:
        """The table of ``build()``; ``inputs`` are the files it reads, ``root()`` gives a new shared folder."""
        key = (spark.sparkContext.applicationId, name, fingerprint(spark, inputs))
        with self._building:
            if key not in self._paths:
                path = f"{root()}/{name}"
                with short_methods(spark):
                    write(build(), path)
                self._paths[key] = path
        return spark.read.parquet(self._paths[key])
