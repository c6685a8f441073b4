"""Bounded runs over topics by offset ranges, with the ranges kept in a table.

A run reads, for every partition of a topic, the records from where the last run ended up to the newest one at its start.
Topics seen for the first time start at their newest record, or at the earliest if told so; a partition that appears later
starts at 0. The ranges are saved once all topics are stored, so a run that stops half way is repeated as a whole,
and what it had stored already is skipped by key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import tables
from millrace.streaming.jobs import land_records

RANGES = "topic string, partition int, start_offset long, end_offset long"
_LAYER, _TABLE = "bronze", "kafka_offsets"


def newest_offsets(records: DataFrame, topics: Sequence[str]) -> DataFrame:
    """topic, partition and the offset after the newest record. One row per partition."""
    known = records.where(F.col("topic").isin(*topics))
    return known.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def saved_ranges(spark: SparkSession, root: str) -> DataFrame:
    """The ranges of the last complete run."""
    if not tables.versions(spark, root, _LAYER, _TABLE):
        return spark.createDataFrame([], RANGES)
    return tables.read_as_of(spark, root, _LAYER, _TABLE)


def next_ranges(newest: DataFrame, saved: DataFrame, bootstrap: bool) -> DataFrame:
    """topic, partition, start_offset and end_offset of the next run; a partition without new records has equal ends.

    Partitions that were saved but have no records left keep their end.
    """
    before = saved.select("topic", "partition", F.col("end_offset").alias("_saved"))
    seen = before.select("topic").distinct().withColumn("_seen", F.lit(True))
    joined = newest.join(before, ["topic", "partition"], "full").join(seen, "topic", "left")
    first = F.when(F.col("_seen"), F.lit(0)).when(F.lit(bootstrap), F.lit(0)).otherwise(F.col("end_offset"))
    start = F.coalesce("_saved", first).cast("long")
    end = F.greatest(F.coalesce("end_offset", start), start)
    return joined.select("topic", "partition", start.alias("start_offset"), end.alias("end_offset"))


def in_ranges(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records of the ranges. One row per partition is broadcast; topics and the smallest start prune the scan."""
    todo = ranges.where("end_offset > start_offset")
    spans = todo.groupBy("topic").agg(F.min("start_offset").alias("low"), F.max("end_offset").alias("high")).collect()
    if not spans:
        return records.where(F.lit(False))
    low, high = min(s["low"] for s in spans), max(s["high"] for s in spans)
    pruned = records.where(F.col("topic").isin(*(s["topic"] for s in spans)) & F.col("offset").between(low, high - 1))
    met = pruned.join(F.broadcast(todo), ["topic", "partition"])
    return met.where("offset >= start_offset and offset < end_offset").select(*records.columns)


def ingest_topics(
    spark: SparkSession, records: DataFrame, root: str, topics: Sequence[str], at: dt.datetime, bootstrap: bool = False, now: Column | None = None
) -> DataFrame:
    """One run: the new records of ``topics`` into their bronze tables, then the ranges as a new version of their table.

    Returns the ranges of this run.
    """
    ranges = next_ranges(newest_offsets(records, topics), saved_ranges(spark, root), bootstrap).persist()
    try:
        land_records(in_ranges(records, ranges), root, now)
        path = tables.publish(ranges, root, _LAYER, _TABLE, at)
    finally:
        ranges.unpersist()
    return spark.read.schema(RANGES).parquet(path)


def init_offsets(spark: SparkSession, records: DataFrame, root: str, topics: Sequence[str], at: dt.datetime) -> DataFrame:
    """Note the newest offsets without reading: the next run takes what comes after them."""
    ends = newest_offsets(records, topics).select("topic", "partition", F.col("end_offset").alias("start_offset"), "end_offset")
    return spark.read.schema(RANGES).parquet(tables.publish(ends, root, _LAYER, _TABLE, at))
