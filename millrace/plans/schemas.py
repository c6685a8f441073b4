"""Declared schemas. Files are read as text and cast, so nothing depends on type inference."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
}


def _struct(spec: str) -> T.StructType:
    """Columns given as ``name type, ..``; unlike the DDL reader this needs no running session."""
    pairs = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


def as_text(schema: T.StructType) -> T.StructType:
    """The same columns, all as strings: the shape of a header CSV or JSON drop before casting."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


# Column names and types of the batch tables.
MES_EVENTS = _struct(
    "event_id string, machine_id string, batch_id string, product_code string, parameter_name string, "
    "parameter_value double, unit string, operator_id string, shift string, event_ts timestamp, status string"
)
IQMS_ORDERS = _struct(
    "order_id string, product_code string, batch_id string, quantity int, uom string, planned_start timestamp, "
    "actual_start timestamp, actual_end timestamp, status string, line_id string"
)
TRACKWISE_DEVIATIONS = _struct(
    "deviation_id string, batch_id string, product_code string, deviation_type string, severity string, "
    "description string, reported_by string, reported_ts timestamp, status string, resolution_ts timestamp"
)
SAP_ECC_ORDERS = _struct(
    "po_number string, material_code string, plant string, storage_location string, planned_qty int, actual_qty int, "
    "uom string, posting_date date, cost_center string, total_cost double, currency string"
)
SOP_DOCUMENTS = _struct(
    "doc_id string, doc_type string, title string, version string, effective_date date, author string, "
    "department string, file_path string, page_count int"
)

# One row of a Kafka source, and the raw envelope row made of it.
KAFKA_RECORD = _struct(
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"
)
RAW_ENVELOPE = _struct(
    "_kafka_key string, _raw_payload string, _ingested_at timestamp, _row_hash string, _kafka_offset bigint, "
    "_source_system string, _ingest_year int, _ingest_month int, _ingest_day int"
)

# Training records stay text in bronze.
TMS_FIELDS = [
    "record_id",
    "employee_id",
    "employee_name",
    "department",
    "training_name",
    "training_category",
    "scheduled_date",
    "completion_date",
    "score",
    "status",
    "trainer_id",
    "training_mode",
    "validity_months",
]
TMS_TRAINING = _struct(", ".join(f"{f} string" for f in TMS_FIELDS) + ", _source string, _ingested_at timestamp")

# Tables created empty when absent, so later layers can always read them.
PLACEHOLDERS = {
    "tms_training_completions": TMS_TRAINING,
    "trackwise_capas": RAW_ENVELOPE,
    "mes_production_orders": RAW_ENVELOPE,
    "iqms_quality_tests": RAW_ENVELOPE,
    "iqms_deviations": RAW_ENVELOPE,
}

# Which topic feeds which bronze table, and which fields key it.
RAW_TOPICS = {
    "mes.production_orders": "mes_production_orders",
    "cdc.mes.public.mes_production_orders": "mes_production_orders",
    "iqms.quality_tests": "iqms_quality_tests",
    "cdc.iqms.public.iqms_quality_tests": "iqms_quality_tests",
    "iqms.deviations": "iqms_deviations",
    "trackwise.capas": "trackwise_capas",
}
STRUCTURED_TOPICS = {
    "sap.inventory_movements": "sap_ecc_orders",
    "tms.training_completions": "tms_training_completions",
    "cdc.tms.public.tms_training_completions": "tms_training_completions",
}
ARCHIVE_ONLY_TOPICS = [
    "mes.machine_status",
    "mes.oee_metrics",
    "historian.process_parameters",
    "trackwise.complaints",
    "sap.purchase_orders",
]
RAW_KEYS = ["_row_hash", "_kafka_offset"]
TABLE_KEYS = {"sap_ecc_orders": ["po_number"], "tms_training_completions": ["record_id"]}


def topic_table(topic: str) -> str:
    table = RAW_TOPICS.get(topic) or STRUCTURED_TOPICS.get(topic)
    if table is None:
        raise ValueError(f"no bronze table is declared for topic {topic}")
    return table


def table_keys(table: str) -> list[str]:
    return TABLE_KEYS.get(table, RAW_KEYS)
