"""Plain parquet tables per layer: ensure, write, append, publish by version, maintain.

Bronze is appended to. Silver and gold are rebuilt into a fresh version folder
``<root>/<layer>.db/<table>/at=<time>``; a version counts once Spark has put its
_SUCCESS marker there, so a reader never sees half a table and an executor lost
during the write costs nothing but a retry. Tables that are updated day by day are
in ``days``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import freeing_shuffles

LAYERS = ("bronze", "silver", "gold")
AT_ONCE = 4  # tables written at a time
CODEC = "zstd"  # payloads and hashes take about half the disk of the default codec
_STAMP = "%Y%m%dT%H%M%S%f"


def table_path(root: str, layer: str, table: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer}")
    return f"{root.rstrip('/')}/{layer}.db/{table}"


def _path(spark: SparkSession, path: str):
    """(file system, path) as the cluster's own storage layer sees them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


# --- plain tables ------------------------------------------------------------------------------------


def _writer(df: DataFrame, mode: str, partition_by: Sequence[str], rebalance: bool):
    """A writer whose tasks hold whole partitions, so a table does not get one file per task and partition.

    The rebalance also cuts a partition that is too large for one task.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("compression", CODEC)
    return writer.partitionBy(*partition_by) if partition_by else writer


def write_layer_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), rebalance: bool = True) -> None:
    """Create or replace a table. Rows that are clustered already need no ``rebalance``."""
    with freeing_shuffles(df.sparkSession):
        _writer(df, "overwrite", partition_by, rebalance).parquet(path)


def write_layer_tables(written: Mapping[str, DataFrame]) -> None:
    """Create or replace tables that do not depend on each other, given by path.

    A few are written at a time: a table of few or uneven files and the last tasks of any leave cores idle, which take
    tasks of the next table then. No executor runs more tasks at once than before.
    """
    with ExitStack() as held:
        # Held until all are written: a writer that ends puts back what it found.
        for spark in {id(df.sparkSession): df.sparkSession for df in written.values()}.values():
            held.enter_context(freeing_shuffles(spark))
        with ThreadPoolExecutor(AT_ONCE) as writers:
            writes = [
                writers.submit(inheritable_thread_target(df.sparkSession)(write_layer_table), df, path) for path, df in written.items()
            ]
    for write in writes:
        write.result()


def append_layer_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), rebalance: bool = True) -> None:
    """Append rows. Nothing is counted first: an empty append only adds an empty file."""
    with freeing_shuffles(df.sparkSession):
        _writer(df, "append", partition_by, rebalance).parquet(path)


def ensure_tables(spark: SparkSession, root: str, layer: str, schemas: Mapping[str, T.StructType]) -> list[str]:
    """Create the absent ones of the declared tables, empty; the names created are returned."""
    created = []
    for name, schema in schemas.items():
        path = table_path(root, layer, name)
        if not exists(spark, path):
            spark.createDataFrame([], schema).write.parquet(path)
            created.append(name)
    return created


def dual_land(df: DataFrame, demo_path: str, main_path: str) -> DataFrame:
    """Land the same rows in a table of their own and at the end of the main table.

    The rows are written once and read back for the append, so both tables hold the
    same rows even when the source is not repeatable. Returns the row counts.
    """
    spark = df.sparkSession
    before = spark.read.parquet(main_path).count() if exists(spark, main_path) else 0
    write_layer_table(df, demo_path)
    landed = spark.read.parquet(demo_path)
    append_layer_table(landed, main_path)
    return landed.agg(
        F.count(F.lit(1)).alias("demo_rows"),
        F.lit(before).cast("bigint").alias("rows_before"),
    ).withColumn("rows_after", F.lit(spark.read.parquet(main_path).count()).cast("bigint"))


# --- versioned tables --------------------------------------------------------------------------------


def publish(df: DataFrame, root: str, layer: str, table: str, at: dt.datetime, partition_by: Sequence[str] = ()) -> str:
    """Write a new version; readers switch to it when the write is complete."""
    path = f"{table_path(root, layer, table)}/at={at.strftime(_STAMP)}"
    write_layer_table(df, path, partition_by)
    return path


def versions(spark: SparkSession, root: str, layer: str, table: str) -> list[tuple[dt.datetime, str]]:
    """Complete versions, oldest first."""
    fs, p = _path(spark, table_path(root, layer, table))
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        child = status.getPath()
        if child.getName().startswith("at=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS")):
            found.append((dt.datetime.strptime(child.getName()[3:], _STAMP), child.toString()))
    return sorted(found)


def read_as_of(spark: SparkSession, root: str, layer: str, table: str, at: dt.datetime | None = None) -> DataFrame:
    """The newest complete version, or the one that was newest at a given time."""
    fitting = [path for when, path in versions(spark, root, layer, table) if at is None or when <= at]
    if not fitting:
        raise ValueError(f"{layer}.{table} has no version" + (f" at {at}" if at else ""))
    return spark.read.parquet(fitting[-1])


def compact_table(spark: SparkSession, root: str, layer: str, table: str, at: dt.datetime) -> str:
    """Rewrite the newest version into files of the advised size.

    The rebalance hint lets adaptive execution join small partitions and split large
    ones by measured bytes, so no file count has to be guessed.
    """
    return publish(read_as_of(spark, root, layer, table).hint("rebalance"), root, layer, table, at)


def expire_versions(
    spark: SparkSession, root: str, layer: str, table: str, now: dt.datetime, keep: int = 5, days: int = 7
) -> list[str]:
    """Delete versions older than ``days``, but never the newest ``keep``."""
    complete = versions(spark, root, layer, table)
    limit = now - dt.timedelta(days=days)
    doomed = [path for when, path in complete[: max(len(complete) - keep, 0)] if when < limit]
    for path in doomed:
        fs, p = _path(spark, path)
        fs.delete(p, True)
    return doomed


def analyze_tables(spark: SparkSession, database: str, tables: Sequence[str]) -> None:
    """Refresh row and column statistics, which join planning uses."""
    for table in tables:
        spark.sql(f"analyze table `{database}`.`{table}` compute statistics for all columns")


def storage_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Name, path and size of every data file of the given tables.

    The listing has one row per file and its content column is never read, so the cost
    follows the number of files, not of rows.
    """
    parts = [
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.lit(name).alias("table"), F.col("path").alias("file_path"), F.col("length").alias("file_size"))
        for name, path in paths.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
