"""Bronze: typed loads of batch files and projections of Kafka records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import with_json_fields
from millrace.operators.dedup import dedup_latest
from millrace.plans import schemas


def with_metadata(df: DataFrame, source: str, flow: str, now: Column) -> DataFrame:
    """Stamp where a row came from and when it was taken in."""
    return df.withColumns({"_source": F.lit(source), "_ingested_at": now, "_nifi_flow": F.lit(flow)})


def cluster_by_day(df: DataFrame, ts_col: str) -> DataFrame:
    """Rows of a day next to each other and sorted by time within a partition.

    A rebalance rather than a plain repartition by day: adaptive execution joins quiet
    days and cuts a busy one into partitions of the advised size, by measured bytes.
    """
    day = "_millrace_day"
    return df.withColumn(day, F.to_date(ts_col)).hint("rebalance", day).sortWithinPartitions(day, ts_col).drop(day)


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast a text-typed drop to its declared columns; unreadable values become NULL."""
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def _load(raw, schema, source, flow, now, key, latest_by):
    stamped = with_metadata(typed(raw, schema), source, flow, now)
    return dedup_latest(stamped, [key], latest_by)


def load_mes_events(raw: DataFrame, flow: str, now: Column) -> DataFrame:
    """Machine events, newest version of each event."""
    return _load(raw, schemas.MES_EVENTS, "MES", flow, now, "event_id", ["event_ts"])


def load_iqms_orders(raw: DataFrame, flow: str, now: Column) -> DataFrame:
    """Production orders of the quality system, latest start wins."""
    return _load(raw, schemas.IQMS_ORDERS, "IQMS", flow, now, "order_id", ["actual_start"])


def load_trackwise_deviations(raw: DataFrame, flow: str, now: Column) -> DataFrame:
    return _load(raw, schemas.TRACKWISE_DEVIATIONS, "TrackWise", flow, now, "deviation_id", ["reported_ts"])


def load_sap_orders(raw: DataFrame, flow: str, now: Column) -> DataFrame:
    """Purchase orders; lines posted on the same day are settled by the higher cost."""
    return _load(raw, schemas.SAP_ECC_ORDERS, "SAP ECC", flow, now, "po_number", ["posting_date", "total_cost"])


def load_sop_documents(raw: DataFrame, flow: str, now: Column) -> DataFrame:
    return _load(raw, schemas.SOP_DOCUMENTS, "Document Index", flow, now, "doc_id", ["effective_date"])


def raw_envelope(records: DataFrame, now: Column) -> DataFrame:
    """Kafka records as schema-free rows: payload text, its hash, offset, system and ingest date."""
    text = F.col("value").cast("string")
    return records.select(
        F.col("key").cast("string").alias("_kafka_key"),
        text.alias("_raw_payload"),
        now.alias("_ingested_at"),
        F.sha2(text, 256).alias("_row_hash"),
        F.col("offset").cast("bigint").alias("_kafka_offset"),
        F.upper(F.split_part("topic", F.lit("."), F.lit(1))).alias("_source_system"),
        F.year(now).alias("_ingest_year"),
        F.month(now).alias("_ingest_month"),
        F.dayofmonth(now).alias("_ingest_day"),
    )


def project_training(records: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Training records as text columns; the message key stands in for a missing record id. ``keep``: record columns."""
    parsed = with_json_fields(records.select("key", "value", *keep), F.col("value").cast("string"), schemas.TMS_FIELDS)
    return parsed.select(
        F.coalesce("record_id", F.col("key").cast("string")).alias("record_id"),
        *schemas.TMS_FIELDS[1:],
        F.lit("TMS").alias("_source"),
        now.alias("_ingested_at"),
        *keep,
    ).where(F.col("record_id").isNotNull())


def project_inventory(records: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Inventory movements in the shape of purchase orders; the fractional quantity is cut to whole units.

    ``keep``: record columns.
    """
    names = [
        "document_number",
        "material_code",
        "plant",
        "storage_location",
        "quantity",
        "uom",
        "posting_date",
        "movement_type",
        "valuation_amount_inr",
    ]
    parsed = with_json_fields(records.select("value", *keep), F.col("value").cast("string"), names)
    quantity = F.col("quantity").try_cast("double").try_cast("int")
    return parsed.select(
        F.col("document_number").alias("po_number"),
        "material_code",
        "plant",
        "storage_location",
        quantity.alias("planned_qty"),
        quantity.alias("actual_qty"),
        "uom",
        F.col("posting_date").try_cast("date").alias("posting_date"),
        F.col("movement_type").alias("cost_center"),
        F.col("valuation_amount_inr").try_cast("double").alias("total_cost"),
        F.lit("INR").alias("currency"),
        F.lit("SAP_ECC_KAFKA").alias("_source"),
        now.alias("_ingested_at"),
        F.lit("kafka_bronze_ingest").alias("_nifi_flow"),
        *keep,
    ).where(F.col("po_number").isNotNull())


def project_topic(topic: str, records: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The bronze rows a topic's records turn into. ``keep``: record columns that keyed rows carry on (raw rows hold
    the offset anyway)."""
    table = schemas.topic_table(topic)
    if table == "tms_training_completions":
        return project_training(records, now, keep)
    if table == "sap_ecc_orders":
        return project_inventory(records, now, keep)
    return raw_envelope(records, now)


def extent(df: DataFrame, ts_col: str) -> DataFrame:
    """Row count and time span of a loaded table."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts_col).alias(f"min_{ts_col}"),
        F.max(ts_col).alias(f"max_{ts_col}"),
    )
