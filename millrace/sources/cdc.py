"""Change events of source databases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.dedup import keep_latest


def cdc_unwrap(records: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of change events with the envelope ``before, after, source, op``.

    Rows hold the new state plus ``__op, __table, __source_ts_ms``; tombstones (no value)
    and deletions (no new state) are dropped. Text that cannot be read as an event, or
    that names no operation, goes to the dead letters with its key and offset.
    """
    envelope = (
        f"after {schema.simpleString()}, op string, source struct<table:string, ts_ms:bigint>, _bad string"
    )
    parsed = (
        records.where(F.col("value").isNotNull())
        .select("key", "topic", "partition", "offset", F.col("value").cast("string").alias("_text"))
        .withColumn(
            "_event",
            F.from_json("_text", envelope, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
        )
    )
    broken = F.col("_event._bad").isNotNull() | F.col("_event.op").isNull()
    rows = parsed.where(~broken & F.col("_event.after").isNotNull()).select(
        "_event.after.*",
        F.col("_event.op").alias("__op"),
        F.col("_event.source.table").alias("__table"),
        F.col("_event.source.ts_ms").alias("__source_ts_ms"),
        F.col("offset").alias("_offset"),
    )
    dead = parsed.where(broken).select(F.col("key").cast("string").alias("key"), "topic", "partition", "offset", F.col("_text").alias("value"))
    return rows, dead


def cdc_latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest state per key."""
    return keep_latest(rows, keys, ["__source_ts_ms", "_offset"])
