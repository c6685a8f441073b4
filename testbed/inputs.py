"""Bronze-shaped inputs derived from the given tables.

Each input is a list of SQL expressions over one table, in the dialect Spark and
DuckDB share. The Spark side turns them into DataFrames, the checking side into
common table expressions, so both engines start from the same rows. Only inputs
are shared; every model is written twice, independently.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lookup import planned_bytes
from millrace.plans import bronze
from millrace.plans.registry import Context

SMALL_INPUT = 64 << 20

INGESTED = dt.datetime(2024, 2, 1, 6, 30, 0)
EVENTS_AS_OF = dt.date(2024, 1, 31)
ORDERS_AS_OF = dt.date(2001, 12, 1)
CAPAS_AS_OF = dt.date(2024, 12, 1)
OEE_AS_OF = dt.date(2001, 11, 5)

INGESTED_SQL = "timestamp '2024-02-01 06:30:00'"

# Columns cast on read: the files hold zone-less timestamps, watermarks need zoned ones.
_TIMESTAMPS = {"events": ["ts"], "orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}


@dataclass(frozen=True)
class Input:
    source: str
    columns: dict[str, str]
    where: str = "true"


def _iso(ts: str) -> str:
    return f"replace(cast({ts} as string), ' ', 'T')"


def _product(k: str) -> str:
    return f"concat('API-', cast(({k} % 6 + 1) * 100 as string))"


def _machine(k: str) -> str:
    return f"concat('MCH-', lpad(cast({k} % 15 + 1 as string), 3, '0'))"


def _json(**fields: str) -> str:
    """JSON text; a field given as ('text', expr) is quoted, as ('raw', expr) is not."""
    parts = []
    for name, (kind, expr) in fields.items():
        value = f"'\"', {expr}, '\"'" if kind == "text" else expr
        parts.append(f"'\"{name}\": ', {value}")
    return "concat('{', " + ", ', ', ".join(parts) + ", '}')"


def _nullable_text(condition: str, expr: str) -> str:
    return f"case when {condition} then 'null' else concat('\"', {expr}, '\"') end"


# Orders moved 23 years on, so the last corrective actions meet the month of the events.
_CAPA_OPENED = "o_orderdate + 8401 * interval '1' day"

_EVENT_BATCH = "concat('BATCH-', cast(cast(floor(event_id / 4) as bigint) as string))"

# Tables with repeated rows: the n-th condition selects the rows that get copy number n.
COPIES = {
    "events_twice": ("events", ["true", "event_id % 20 = 0"]),
    # Change events: creations, updates, deletions, their tombstones, and broken text.
    "order_changes": (
        "orders",
        ["true", "o_orderkey % 3 = 0", "o_orderkey % 15 = 0", "o_orderkey % 15 = 0", "o_orderkey % 50 = 7"],
    ),
}

INPUTS: dict[str, Input] = {
    # A second, older copy of every 20th event exercises de-duplication.
    "raw_mes_events": Input(
        "events_twice",
        {
            "event_id": "concat('EVT-', cast(event_id as string))",
            "machine_id": _machine("user_id"),
            "batch_id": _EVENT_BATCH,
            "product_code": _product("user_id"),
            "parameter_name": "case event_type when 'click' then 'temperature' when 'view' then 'pressure' "
            "when 'purchase' then 'ph_level' when 'signup' then 'rpm' else 'viscosity' end",
            "parameter_value": "case event_type when 'click' then 20 + value / 10 when 'view' then 1 + value / 15 "
            "when 'purchase' then cast(6.6 as double) + value / 100 else value * 3 end",
            "unit": "case when event_id % 50 = 0 then null else 'u' end",
            "operator_id": "case when event_id % 40 = 0 then null else concat('OP', cast(user_id % 30 as string)) end",
            "shift": "substr('ABC', cast(event_id % 3 + 1 as int), 1)",
            "event_ts": "ts - copy * interval '1' hour",
            "status": "case when copy = 1 then 'fail' when event_id % 10 = 0 then 'fail' when event_id % 10 = 1 then 'WARNING' "
            "when event_id % 10 = 2 then null else 'pass' end",
        },
    ),
    "raw_iqms_orders": Input(
        "orders",
        {
            "order_id": "concat('ORD-', cast(o_orderkey as string))",
            "product_code": _product("o_custkey"),
            "batch_id": "concat('BATCH-', cast((o_orderkey % 1000) * 2 as string))",
            "quantity": "cast(floor(o_totalprice / 100) as int)",
            "uom": "'KG'",
            "planned_start": "o_orderdate",
            "actual_start": "case when o_orderkey % 7 = 0 then null else o_orderdate + (o_orderkey % 5) * interval '1' hour end",
            "actual_end": "o_orderdate + (o_orderkey % 9 + 5) * interval '1' hour",
            "status": "case o_orderstatus when 'P' then 'in_progress' when 'O' then 'PLANNED' else 'COMPLETE' end",
            "line_id": "concat('LINE-', cast(o_custkey % 8 + 1 as string))",
        },
    ),
    "raw_trackwise_deviations": Input(
        "events",
        {
            "deviation_id": "concat('DEV-', cast(event_id as string))",
            "batch_id": "concat('BATCH-', cast(cast(floor(event_id / 4) as bigint) + 50 as string))",
            "product_code": _product("user_id"),
            "deviation_type": "case when event_id % 2 = 0 then 'Process' else 'Equipment' end",
            "severity": "case user_id % 3 when 0 then 'critical' when 1 then 'MAJOR' else 'MINOR' end",
            "description": "concat('value ', cast(event_id % 17 as string), ' out of range')",
            "reported_by": "concat('OP', cast(user_id % 30 as string))",
            "reported_ts": "ts",
            "status": "case event_id % 3 when 0 then 'OPEN' when 1 then 'IN_REVIEW' else 'CLOSED' end",
            "resolution_ts": "case when event_id % 3 = 2 then ts + (event_id % 90) * interval '1' hour else null end",
        },
    ),
    "raw_sap_ecc_orders": Input(
        "lineitem",
        {
            "po_number": "concat('PO-', cast(l_orderkey as string), '-', cast(l_linenumber as string))",
            "material_code": "concat('MAT-', cast((l_partkey % 6 + 1) * 100 as string))",
            "plant": "concat('PLANT0', cast(l_suppkey % 3 + 1 as string))",
            "storage_location": "concat('SL', cast(l_linenumber % 4 as string))",
            "planned_qty": "cast(l_quantity as int)",
            "actual_qty": "case when l_partkey % 97 = 0 then null else cast(floor(l_quantity * (1 - l_discount)) as int) end",
            "uom": "'KG'",
            "posting_date": "cast(l_shipdate as date)",
            "cost_center": "concat('CC-', cast(l_suppkey % 900 + 100 as string))",
            "total_cost": "l_extendedprice",
            "currency": "'USD'",
        },
    ),
    "raw_sop_documents": Input(
        "documents",
        {
            "doc_id": "concat('SOP-', cast(doc_id as string))",
            "doc_type": "case doc_id % 4 when 0 then 'SOP' when 1 then 'Policy' when 2 then 'Form' else 'Report' end",
            "title": "concat('Document ', cast(doc_id as string), ' (', lang, ')')",
            "version": "concat('v', cast(doc_id % 5 + 1 as string), '.0')",
            "effective_date": "date '2020-01-01' + cast(doc_id % 1000 as int)",
            "author": "concat('Author ', cast(doc_id % 23 as string))",
            "department": "case doc_id % 3 when 0 then 'QA' when 1 then 'QC' else 'Production' end",
            "file_path": "concat('/sops/', source, '/', cast(doc_id as string), '.txt')",
            "page_count": "cast(floor(n_chars / 1000) as int) + 1",
        },
    ),
    "kafka_mes_production_orders": Input(
        "lineitem",
        {
            "key": "concat('PO-', cast(l_orderkey as string), '-', cast(l_linenumber as string))",
            "value": _json(
                order_id=("text", "concat('PO-', cast(l_orderkey as string), '-', cast(l_linenumber as string))"),
                product_code=("text", _product("l_partkey")),
                batch_number=("text", "concat('BATCH-', cast(l_orderkey % 300 as string))"),
                machine_id=("text", _machine("l_suppkey")),
                operator_id=("text", "concat('OPR-', cast(l_suppkey % 50 + 1 as string))"),
                shift=("text", "substr('abc', cast(l_linenumber % 3 + 1 as int), 1)"),
                plant=("text", "concat('P', cast(l_suppkey % 2 + 1 as string))"),
                planned_qty=(
                    "raw",
                    "case when l_partkey % 211 = 0 then '0' else cast(cast(l_quantity as int) * 100 as string) end",
                ),
                actual_qty=(
                    "raw",
                    "cast(cast(l_quantity as int) * 100 - cast(floor(l_discount * 100) as int) * cast(l_quantity as int) as string)",
                ),
                rejected_qty=("raw", "cast(cast(floor(l_tax * 100) as int) as string)"),
                start_time=("text", _iso("l_shipdate")),
                end_time=("text", _iso("l_shipdate + l_linenumber * interval '1' hour")),
                status=("text", "case l_returnflag when 'A' then 'completed ' when 'R' then 'IN_PROGRESS' else 'ON_HOLD' end"),
                scrap_percentage=(
                    "raw",
                    "case when l_partkey % 13 = 0 then 'null' else concat(cast(l_partkey % 3 as string), '.', "
                    "lpad(cast(l_suppkey % 100 as string), 2, '0')) end",
                ),
            ),
            "topic": "'mes.production_orders'",
            "partition": "cast(l_orderkey % 3 as int)",
            "offset": "l_orderkey * 1000 + l_partkey % 1000",
            "timestamp": "l_shipdate",
        },
    ),
    "kafka_iqms_quality_tests": Input(
        "lineitem",
        {
            "key": "concat('QT-', cast(l_orderkey as string), '-', cast(l_linenumber as string))",
            "value": _json(
                test_id=("text", "concat('QT-', cast(l_orderkey as string), '-', cast(l_linenumber as string))"),
                batch_number=("text", "concat('BATCH-', cast(l_orderkey % 300 as string))"),
                product_code=("text", _product("l_partkey")),
                machine_id=("text", _machine("l_suppkey")),
                test_type=("text", "case l_partkey % 3 when 0 then 'hardness' when 1 then 'ASSAY' else ' Moisture' end"),
                result_value=(
                    "raw",
                    "case when l_partkey % 500 = 0 then '\"n/a\"' else cast(90 + cast(l_quantity as int) % 21 as string) end",
                ),
                usl=("raw", "case when l_partkey % 29 = 0 then 'null' else '105' end"),
                lsl=("raw", "'95'"),
                result=("text", "case when 90 + cast(l_quantity as int) % 21 between 91 and 109 then 'pass' else 'FAIL' end"),
                analyst_id=("text", "concat('OPR-', cast(l_suppkey % 50 + 1 as string))"),
                equipment_id=("text", "concat('EQP-', cast(l_partkey % 100 + 100 as string))"),
                tested_at=("text", _iso("l_shipdate")),
                approved_by=("raw", _nullable_text("l_partkey % 5 = 0", "concat('OPR-', cast(l_partkey % 50 as string))")),
            ),
            "topic": "'iqms.quality_tests'",
            "partition": "cast(l_orderkey % 3 as int)",
            "offset": "l_orderkey * 1000 + l_partkey % 1000",
            "timestamp": "l_shipdate",
        },
    ),
    "kafka_iqms_deviations": Input(
        "events_twice",
        {
            "key": "concat('DEV-', cast(event_id as string))",
            "value": _json(
                deviation_id=("text", "concat('DEV-', cast(event_id as string))"),
                batch_number=("text", "concat('BATCH-', cast(event_id % 300 as string))"),
                product_code=("text", _product("user_id")),
                defect_code=("text", "concat('DEF-00', cast(user_id % 5 + 1 as string))"),
                severity=("text", "case event_id % 3 when 0 then ' critical' when 1 then 'MAJOR' else 'MINOR' end"),
                description=(
                    "raw",
                    "case when user_id % 7 = 0 then '{\"nested\": 1}' else concat('\"{draft} note ', "
                    "cast(user_id as string), '\"') end",
                ),
                detected_by=("text", "concat('OPR-', cast(user_id % 50 + 1 as string))"),
                detected_at=("text", _iso("ts")),
                status=(
                    "text",
                    "case when copy = 1 then 'OPEN' when event_id % 4 = 0 then 'open' when event_id % 4 = 1 then 'UNDER_INVESTIGATION' "
                    "else 'Closed' end",
                ),
                root_cause=("raw", _nullable_text("event_id % 5 < 2", "concat('cause ', cast(event_id % 9 as string))")),
            ),
            "topic": "'iqms.deviations'",
            "partition": "0",
            "offset": "event_id * 2 + 1 - copy",
            "timestamp": "ts",
        },
    ),
    "kafka_trackwise_capas": Input(
        "orders",
        {
            "key": "concat('CAPA-', cast(o_orderkey as string))",
            "value": _json(
                capa_id=("text", "concat('CAPA-', cast(o_orderkey as string))"),
                capa_type=("text", "case o_custkey % 3 when 0 then 'CAPA-HUM' when 1 then 'CAPA-MAC' else 'CAPA-ENV' end"),
                title=("text", "concat('Action ', cast(o_orderkey as string))"),
                description=("text", "concat('Follow up for customer ', cast(o_custkey as string))"),
                source=("text", "case o_orderkey % 2 when 0 then 'Audit' else 'Deviation' end"),
                product_code=("text", _product("o_custkey")),
                department=("text", "substr(o_orderpriority, 3)"),
                owner=("text", "concat('OPR-', cast(o_custkey % 50 + 1 as string))"),
                opened_date=("text", _iso(_CAPA_OPENED)),
                target_close_date=("text", _iso(f"{_CAPA_OPENED} + 60 * interval '1' day")),
                actual_close_date=(
                    "raw",
                    _nullable_text("o_orderstatus = 'O'", _iso(f"{_CAPA_OPENED} + (o_custkey % 150) * interval '1' day")),
                ),
                status=(
                    "text",
                    "case o_orderkey % 5 when 0 then 'open' when 1 then 'IN_PROGRESS' when 2 then 'COMPLETED' "
                    "when 3 then 'VERIFIED' else 'CLOSED ' end",
                ),
                effectiveness_verified=(
                    "raw",
                    "case o_orderkey % 3 when 0 then 'true' when 1 then 'false' else 'null' end",
                ),
            ),
            "topic": "'trackwise.capas'",
            "partition": "cast(o_orderkey % 2 as int)",
            "offset": "o_orderkey",
            "timestamp": "o_orderdate",
        },
    ),
    "kafka_cdc_orders": Input(
        "order_changes",
        {
            "key": "concat('ORD-', cast(o_orderkey as string))",
            "value": "case when copy = 3 then null when copy = 4 then concat('{\"op\": broken ', cast(o_orderkey as string)) else "
            + _json(
                before=("raw", "'null'"),
                after=(
                    "raw",
                    "case when copy = 2 then 'null' else "
                    + _json(
                        order_id=("text", "concat('ORD-', cast(o_orderkey as string))"),
                        product_code=("text", _product("o_custkey")),
                        quantity=("raw", "cast(o_custkey + copy * 1000 as string)"),
                        status=("text", "case copy when 0 then 'PLANNED' else 'IN_PROGRESS' end"),
                    )
                    + " end",
                ),
                source=(
                    "raw",
                    "concat('{\"table\": \"mes_production_orders\", \"ts_ms\": ', cast(1700000000000 + copy * 60000 as string), '}')",
                ),
                op=("text", "case copy when 0 then 'c' when 1 then 'u' else 'd' end"),
            )
            + " end",
            "topic": "'cdc.mes.public.mes_production_orders'",
            "partition": "0",
            "offset": "o_orderkey * 5 + copy",
            "timestamp": "o_orderdate",
        },
    ),
    # Answers of every kind: complete, without parts, and with unusable or excessive confidences.
    "answers": Input(
        "conversations",
        {
            "conv_id": "conv_id",
            "turn": "turn",
            "response": "concat(case when conv_id % 7 = 0 then '' else 'Sure. ANSWER:  ' end, text, "
            "case conv_id % 5 when 0 then '' when 1 then ' CONFIDENCE: 0.85' when 2 then ' CONFIDENCE: very high' "
            "when 3 then '\nCONFIDENCE: 1.7\n' else ' CONFIDENCE: .25 ' end, "
            "case when conv_id % 3 = 0 then '' else concat('SOURCES: doc', cast(turn as string), '.txt') end)",
        },
        "role = 'assistant'",
    ),
    "questions": Input(
        "conversations",
        {
            "conv_id": "conv_id",
            "turn": "turn",
            "question": "concat(text, case conv_id % 4 when 0 then ' What is the OEE?' when 1 then ' Which PLANT made it?' else '' end)",
        },
        "role = 'user'",
    ),
    "kafka_sap_inventory": Input(
        "lineitem",
        {
            "key": "concat('49', lpad(cast(l_orderkey as string), 8, '0'))",
            "value": _json(
                document_number=(
                    "raw",
                    _nullable_text("l_partkey % 41 = 0", "concat('49', lpad(cast(l_orderkey * 8 + l_linenumber as string), 10, '0'))"),
                ),
                movement_type=("text", "case l_linenumber % 3 when 0 then '101' when 1 then '261' else '551' end"),
                material_code=("text", "concat('MAT-', cast((l_partkey % 6 + 1) * 100 as string))"),
                plant=("text", "concat('P', cast(l_suppkey % 2 + 1 as string))"),
                storage_location=("text", "concat('SL', cast(l_linenumber % 4 as string))"),
                quantity=("raw", "concat(cast(cast(l_quantity as int) as string), '.', lpad(cast(l_partkey % 1000 as string), 3, '0'))"),
                uom=("text", "case l_partkey % 2 when 0 then 'KG' else 'EA' end"),
                posting_date=("text", "cast(cast(l_shipdate as date) as string)"),
                valuation_amount_inr=(
                    "raw",
                    "concat(cast(l_partkey % 5000 + 1000 as string), '.', lpad(cast(l_suppkey % 100 as string), 2, '0'))",
                ),
            ),
            "topic": "'sap.inventory_movements'",
            "partition": "cast(l_orderkey % 3 as int)",
            "offset": "l_orderkey * 1000 + l_partkey % 1000",
            "timestamp": "l_shipdate",
        },
    ),
    "kafka_tms_training": Input(
        "orders",
        {
            "key": "concat('KEY-', cast(o_orderkey as string))",
            "value": _json(
                record_id=("raw", _nullable_text("o_orderkey % 11 = 0", "concat('TR-', cast(o_orderkey as string))")),
                employee_id=("text", "concat('OPR-', cast(o_custkey % 50 + 1 as string))"),
                employee_name=("text", "concat('Employee ', cast(o_custkey as string))"),
                department=(
                    "text",
                    "case o_orderkey % 6 when 0 then 'Manufacturing' when 1 then 'QC' when 2 then 'QA' when 3 then 'Packaging' "
                    "when 4 then 'Warehouse' else 'Engineering' end",
                ),
                training_name=("text", "case o_custkey % 2 when 0 then 'GMP Basics' else 'Data Integrity' end"),
                training_category=("text", "case o_custkey % 3 when 0 then 'GMP' when 1 then 'Safety' else 'Technical' end"),
                scheduled_date=("text", "cast(cast(o_orderdate as date) as string)"),
                completion_date=(
                    "raw",
                    _nullable_text(
                        "o_orderkey % 10 = 3", "cast(cast(o_orderdate + (o_orderkey % 6) * interval '1' day as date) as string)"
                    ),
                ),
                score=("raw", "case when o_orderkey % 10 = 3 then 'null' else cast(70 + o_orderkey % 31 as string) end"),
                status=(
                    "text",
                    "case when o_orderkey % 10 <> 3 then 'completed' when o_custkey % 3 = 0 then 'SCHEDULED' "
                    "when o_custkey % 3 = 1 then 'IN_PROGRESS' else 'OVERDUE' end",
                ),
                trainer_id=("text", "concat('OPR-', cast(o_custkey % 20 + 1 as string))"),
                training_mode=("text", "case o_custkey % 2 when 0 then 'Classroom' else 'OJT' end"),
                validity_months=("raw", "case o_custkey % 3 when 0 then '6' when 1 then '12' else '24' end"),
            ),
            "topic": "'tms.training_completions'",
            "partition": "0",
            "offset": "o_orderkey",
            "timestamp": "o_orderdate",
        },
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, zone-less timestamps read as UTC instants."""
    if name in COPIES:
        source, conditions = COPIES[name]
        rows = table(spark, sf_dir, source)
        copies = [rows.where(c).withColumn("copy", F.lit(i)) for i, c in enumerate(conditions)]
        return reduce(DataFrame.unionByName, copies)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c in _TIMESTAMPS.get(name, [])})


def copies_sql(name: str) -> str:
    source, conditions = COPIES[name]
    return " union all ".join(f"select *, {i} as copy from {source} where {c}" for i, c in enumerate(conditions))


def spread(rows: DataFrame) -> DataFrame:
    """Small files over all cores: such a file is one row group and would be read and worked on by one task.

    Real drops, topics and tables arrive in many parts and are left as they are.
    """
    spark = rows.sparkSession
    if planned_bytes(rows) >= SMALL_INPUT:
        return rows
    # By the key: unlike dealing rows out in turn, this needs no sort to be repeatable.
    return rows.repartition(spark.sparkContext.defaultParallelism, rows.columns[0])


def spark_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spec = INPUTS[name]
    rows = table(spark, sf_dir, spec.source).where(spec.where)
    if name.startswith(("raw_", "kafka_")):
        rows = spread(rows)
    shaped = rows.selectExpr(*[f"{expr} as `{column}`" for column, expr in spec.columns.items()])
    if name.startswith("kafka_"):
        shaped = shaped.withColumns(
            {
                "key": F.col("key").cast("binary"),
                "value": F.col("value").cast("binary"),
                "offset": F.col("offset").cast("bigint"),
                "partition": F.col("partition").cast("int"),
            }
        )
    return shaped


def sql_input(name: str) -> str:
    """The same input as a SELECT for the checking engine."""
    spec = INPUTS[name]
    columns = ", ".join(f'{expr} as "{column}"' for column, expr in spec.columns.items())
    return f"select {columns} from {spec.source} where {spec.where}"


def now():
    return F.lit(INGESTED)


def context(as_of: dt.date = EVENTS_AS_OF, columns: Mapping | None = None) -> Context:
    return Context(as_of=as_of, loaded_at=now(), columns=columns or {})


_LOADS = {
    "mes_events": lambda rows: bronze.load_mes_events(rows, "csv_seed", now()),
    "iqms_orders": lambda rows: bronze.load_iqms_orders(rows, "csv_seed", now()),
    "trackwise_deviations": lambda rows: bronze.load_trackwise_deviations(rows, "nifi_s3_ingest", now()),
    "sap_ecc_orders": lambda rows: bronze.load_sap_orders(rows, "nifi_s3_ingest", now()),
    "sop_documents": lambda rows: bronze.load_sop_documents(rows, "csv_seed", now()),
    "mes_production_orders": lambda rows: bronze.raw_envelope(rows, now()),
    "iqms_quality_tests": lambda rows: bronze.raw_envelope(rows, now()),
    "iqms_deviations": lambda rows: bronze.raw_envelope(rows, now()),
    "trackwise_capas": lambda rows: bronze.raw_envelope(rows, now()),
    "tms_training_completions": lambda rows: bronze.project_training(rows, now()),
}
_SOURCES = {name: (f"raw_{name}" if f"raw_{name}" in INPUTS else f"kafka_{name}") for name in _LOADS}
_SOURCES["tms_training_completions"] = "kafka_tms_training"


class BronzeTables(Mapping):
    """The ten bronze tables as lazy plans; a plan is only drawn up for a table that is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._where, self._plans = (spark, sf_dir), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._plans:
            self._plans[name] = _LOADS[name](spark_input(*self._where, _SOURCES[name]))
        return self._plans[name]

    def __contains__(self, name) -> bool:
        return name in _LOADS

    def __iter__(self):
        return iter(_LOADS)

    def __len__(self) -> int:
        return len(_LOADS)


def bronze_tables(spark: SparkSession, sf_dir: str) -> BronzeTables:
    return BronzeTables(spark, sf_dir)
