"""File jobs: profiles, compaction, incremental builds, cached tables, CSV sinks.

Paths can be on any file system Spark writes to. Nothing here uses a
machine-local folder unless the session is itself local.
"""

from __future__ import annotations

import json
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepchange.sources.monthly import stack


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is used on a local session only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="stepchange-")
    return f"{base.rstrip('/')}/stepchange-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def data_files(spark: SparkSession, paths: Iterable[str]) -> list[tuple[str, int]]:
    """Names and sizes of the parquet files at some paths, folders with all below."""
    found = []
    for path in paths:
        system, place = file_system(spark, path)
        entries = system.listFiles(place, True)
        while entries.hasNext():
            entry = entries.next()
            name = entry.getPath().getName()
            if not name.startswith(("_", ".")):
                found.append((entry.getPath().toString(), entry.getLen()))
    return found


#: MB of files whose rows one task of a join puts in order.
TASK_MB = 32


def read_by_key(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """A stored table for a join on keys, so that no task has more to sort when there is more input.

    It is dealt out by the keys in tasks of ``TASK_MB`` if the session's shuffle
    partitions are too few for that, and left as it is otherwise.
    """
    data = spark.read.parquet(path)
    tasks = math.ceil(sum(size for _, size in data_files(spark, [path])) / (TASK_MB * 1e6))
    return data.repartition(tasks, *keys) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else data


def footers(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Rows, columns, row groups and the largest group's bytes of every file, from footers alone.

    Tasks read a footer a file; no data is read, and the driver has names only.
    ``source`` is the path among ``paths`` at which a file was found.
    """

    def read(batches):
        import pyarrow.fs as stores
        import pyarrow.parquet as parquet

        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["bytes"]):
                uri = path if "://" in path else re.sub("^file:/+", "/", path)
                store, place = stores.FileSystem.from_uri(uri)
                meta = parquet.read_metadata(place, filesystem=store)
                groups = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
                rows.append((path, size, meta.num_rows, meta.num_columns, len(groups), max(groups, default=0)))
            found = pd.DataFrame(rows, columns=["path", "bytes", "rows", "columns", "row_groups", "largest_group"])
            yield found.assign(source=batch["source"].to_numpy())

    listed = [(*entry, path) for path in paths for entry in data_files(spark, [path])]
    names = spark.createDataFrame(listed, "path string, bytes long, source string")
    tasks = max(1, min(len(listed), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "path string, bytes long, rows long, columns int, row_groups int, largest_group long, source string"
    return names.repartition(tasks).mapInPandas(read, schema)


def file_profile(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Rows, columns and size of every file, however many there are: one scan of their footers."""
    return _profile(footers(spark, paths).withColumnRenamed("path", "place"))


def table_profile(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """As ``file_profile``, a row a path: the part files of a table stored as a folder add up.

    Columns are those of the widest part.
    """
    parts = footers(spark, [path.rstrip("/") for path in paths])
    return _profile(
        parts.groupBy(F.col("source").alias("place")).agg(
            F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.sum("bytes").alias("bytes")
        )
    )


def _profile(sizes: DataFrame) -> DataFrame:
    file = F.element_at(F.split("place", "/"), -1)
    return sizes.select(
        file.alias("file"),
        # The service is the first word of a file's name
        F.split(F.regexp_replace(file, r"\.parquet$", ""), "_")[0].alias("service"),
        "rows",
        "columns",
        F.round(F.col("bytes") / 1e6, 1).alias("size_mb"),
    )


def column_range(profile: DataFrame) -> DataFrame:
    """Fewest and most columns of each service's files, as text such as 24-25."""
    return (
        profile.groupBy("service")
        .agg(F.min("columns").alias("low"), F.max("columns").alias("high"))
        .select(
            "service",
            F.when(F.col("low") == F.col("high"), F.col("low").cast("string"))
            .otherwise(F.concat_ws("-", "low", "high"))
            .alias("columns"),
        )
    )


def dataset_profile(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of every named dataset."""
    return stack(
        data.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(data.columns)).alias("columns")
        )
        for name, data in datasets.items()
    )


def recompact(
    spark: SparkSession,
    source: str,
    target: str,
    rows_per_file: int = 1_048_576,
    row_group_mb: int = 128,
    max_group_mb: float = 0,
) -> DataFrame:
    """A dataset whose files and row groups are small enough to split.

    Only files with a row group over ``max_group_mb`` (uncompressed; 0 for all
    files) are rewritten, into a folder under ``target``. They are checked against
    the source (rows and schema) before a manifest at ``target`` names them beside
    the files that stay, which keep their place and bytes. The source is left as
    it is.
    """
    large = F.col("largest_group") > max_group_mb * 1e6
    sizes = footers(spark, [source]).select("path", "rows", large.alias("large")).collect()
    todo = [row.path for row in sizes if row.large]
    kept = [row.path for row in sizes if not row.large]
    fresh = []
    if todo:
        data = spark.read.parquet(*todo)
        folder = f"{target.rstrip('/')}/data-{uuid.uuid4().hex}"
        (
            data.write.mode("errorifexists")
            .option("maxRecordsPerFile", rows_per_file)
            .option("parquet.block.size", row_group_mb * 1024 * 1024)
            .option("compression", "zstd")
            .parquet(folder)
        )
        written = spark.read.parquet(folder)
        same_schema = [(f.name, f.dataType) for f in written.schema] == [
            (f.name, f.dataType) for f in data.schema
        ]
        if not same_schema:
            raise ValueError(f"{target}: the rewritten schema doesn't match {source}")
        reconcile(written, sum(row.rows for row in sizes if row.large), target)
        fresh = [path for path, _ in data_files(spark, [folder])]
    _write_manifest(spark, target, [*kept, *fresh])
    return published(spark, target)


def reconcile(data: DataFrame, expected: int, name: str) -> DataFrame:
    """Raise unless a table has the expected number of rows."""
    found = data.count()
    if found != expected:
        raise ValueError(f"{name}: {found:,} rows, but {expected:,} were expected")
    return data


MANIFEST = "_manifest.json"


def _write_manifest(spark: SparkSession, path: str, files: Sequence[str]) -> None:
    """Name a table's files in its manifest, which is replaced in one step."""
    system, folder = file_system(spark, path)
    jvm = spark._jvm
    whole = jvm.org.apache.hadoop.fs.Path(folder, MANIFEST)
    part = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}.part")
    stream = system.create(part, True)
    stream.write(bytearray(json.dumps({"files": list(files)}).encode()))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    place = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        whole.toUri(), spark._jsc.hadoopConfiguration()
    )
    place.rename(part, whole, options)


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that a manifest names, or None without a manifest."""
    system, folder = file_system(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder, MANIFEST)
    if not system.exists(place):
        return None
    stream = system.open(place)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return spark.read.parquet(*json.loads(text)["files"])


def publish(data: DataFrame, path: str) -> DataFrame:
    """Write a table beside its earlier version, then let the manifest name it.

    A reader of the earlier version is never cut off, and a writer that is lost
    half-way leaves the earlier version in place.
    """
    spark = data.sparkSession
    folder = f"{path.rstrip('/')}/data-{uuid.uuid4().hex}"
    data.write.parquet(folder)
    _write_manifest(spark, path, [folder])
    return published(spark, path)


def load_or_build(
    spark: SparkSession, path: str, required: Iterable[str], build: Callable[[], DataFrame]
) -> DataFrame:
    """A published table, or a new version if there is none or it lacks a required column."""
    saved = published(spark, path)
    if saved is not None and set(required) <= set(saved.columns):
        return saved
    return publish(build(), path)


def write_csv(data: DataFrame, path: str) -> None:
    """Write a result table as CSV with a header."""
    data.write.mode("overwrite").option("header", True).csv(path)


def saved_months(spark: SparkSession, path: str) -> DataFrame | None:
    """Months a partitioned table already holds, or None before the first write."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return None
    return table.select("file_month").distinct()


def build_missing_months(
    spark: SparkSession,
    path: str,
    months: Iterable[date],
    build: Callable[[list[date]], DataFrame],
    overwrite: bool = False,
) -> DataFrame:
    """Build only the months that are not saved yet, one partition a month.

    ``build`` gets the missing months and returns rows with ``file_month``. A
    month is written whole or not at all, so a rerun after a failure is safe.
    """
    wanted = list(months)
    saved = None if overwrite else saved_months(spark, path)
    missing = wanted
    if saved is not None:
        requested = spark.createDataFrame([(m,) for m in wanted], "file_month date")
        # At most one row for each month of the study
        rows = requested.join(saved, "file_month", "left_anti").collect()
        missing = sorted(row.file_month for row in rows)
    if missing:
        (
            build(missing)
            # Together if small, a large month in parts of the advisory size
            .hint("rebalance", "file_month")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("file_month")
            .parquet(path)
        )
    return spark.read.parquet(path).where(F.col("file_month").isin(wanted))
