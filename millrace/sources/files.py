"""File sources: CSV, JSON drops, JSON lines, change detection, record splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.dedup import keep_first
from millrace.operators.tables import exists
from millrace.plans.bronze import with_metadata
from millrace.plans.schemas import as_text


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV, every column as text; casting is the loader's business.

    Columns are matched by header name, so a drop with another column order still lines up.
    """
    wanted = as_text(schema)
    return spark.read.option("header", True).option("enforceSchema", False).schema(wanted).csv(path)


def read_json_drop(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file, every field as text."""
    return spark.read.option("multiLine", True).schema(as_text(schema)).json(glob)


def glob_matches(spark: SparkSession, glob: str) -> bool:
    """Whether any file fits a pattern; only names are listed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found)


def preferred_source(
    spark: SparkSession, json_glob: str, csv_path: str, schema: T.StructType, source: str, now: Column
) -> DataFrame:
    """The JSON drop when it holds a row, else the CSV file; rows carry the name of their flow."""
    if glob_matches(spark, json_glob):
        drop = read_json_drop(spark, json_glob, schema)
        if not drop.isEmpty():
            return with_metadata(drop, source, "nifi_s3_ingest", now)
    return with_metadata(read_csv(spark, csv_path, schema), source, "csv_seed", now)


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and modification time of files; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("_metadata.file_path").alias("path"), "length", "modificationTime")
    )


def changed_files(listing: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Files that are new or differ in size or time from the last load's manifest."""
    if manifest is None:
        return listing
    return listing.join(manifest, ["path", "length", "modificationTime"], "left_anti")


def rows_of_changed_files(scan: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Rows of a file scan whose file is new or differs from the manifest's entry (path, length, modificationTime).

    Files are told apart by the scan's own metadata columns, so no list of paths is drawn up anywhere.
    """
    if manifest is None:
        return scan
    marked = scan.select("*", F.col("_metadata").alias("_file"))
    known = (
        (F.col("_file.file_path") == manifest["path"])
        & (F.col("_file.file_size") == manifest["length"])
        & (F.col("_file.file_modification_time") == manifest["modificationTime"])
    )
    return marked.join(manifest, known, "left_anti").select(*scan.columns)


def load_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def split_to_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text per record with the name of the file it came from.

    ``df`` must be read from files. A record's text holds its values as they are; missing
    values stay in as nulls, so every record has the same fields.
    """
    fields = columns or df.columns
    return df.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_filename"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"),
    )


def load_jsonl_latest(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """JSON lines; of several records with one key the last wins, records without key are left out.

    "Last" means the greater file name, then the greater block of a split file, then the
    later line. Line numbers grow within a block, which is all the comparison needs.
    """
    lines = spark.read.schema(schema).json(path).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    keyed = lines.where(F.col(key).isNotNull() & (F.col(key) != ""))
    order = [F.col("_file").desc(), F.col("_block").desc(), F.col("_line").desc()]
    return keep_first(keyed, [key], order).drop("_file", "_block", "_line")
