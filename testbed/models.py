"""Bronze, silver and gold tables as queries."""

from __future__ import annotations

import datetime as dt

from millrace.operators import tables
from millrace.plans import registry
from millrace.plans.pipeline import in_order
from millrace.session import scratch
from testbed import inputs
from testbed.catalogue import add
from testbed.columns import present, shown

STAMP = "_source _ingested_at:ts _nifi_flow"
TAIL = "_ingested_at:ts _row_hash _kafka_offset _source_system _ingest_year _ingest_month _ingest_day"

COLUMNS = {
    "bronze_mes_events": "event_id machine_id batch_id product_code parameter_name parameter_value:6 unit operator_id shift "
    f"event_ts:ts status {STAMP}",
    "bronze_iqms_orders": "order_id product_code batch_id quantity uom planned_start:ts actual_start:ts actual_end:ts status "
    f"line_id {STAMP}",
    "bronze_trackwise_deviations": "deviation_id batch_id product_code deviation_type severity description reported_by "
    f"reported_ts:ts status resolution_ts:ts {STAMP}",
    "bronze_sap_orders": "po_number material_code plant storage_location planned_qty actual_qty uom posting_date:d cost_center "
    f"total_cost:2 currency {STAMP}",
    "bronze_sop_documents": "doc_id doc_type title version effective_date:d author department file_path page_count " + STAMP,
    "bronze_raw_envelope": f"_kafka_key _raw_payload {TAIL}",
    "bronze_tms": "record_id employee_id employee_name department training_name training_category scheduled_date "
    "completion_date score status trainer_id training_mode validity_months _source _ingested_at:ts",
    "silver_mes_events": "event_id machine_id batch_id product_code product_name parameter_name parameter_value:6 unit "
    "operator_id shift event_ts:ts status order_id line_id planned_quantity order_uom planned_start:ts actual_start:ts "
    f"actual_end:ts order_status {STAMP} dq_status",
    "silver_quality_events": "deviation_id batch_id product_code product_name line_id deviation_type severity description "
    "reported_by reported_ts:ts status resolution_ts:ts first_event_ts:ts last_event_ts:ts mes_event_count mes_fail_count "
    f"severity_score time_to_resolution_hours:6 is_open_deviation {STAMP}",
    "silver_production_orders": "order_id batch_id product_code line_id plant storage_location planned_qty:6 actual_qty:6 uom "
    "planned_start:ts actual_start:ts actual_end:ts status posting_date:d cost_center total_cost:4 currency yield:2 "
    "cost_per_unit:2 production_efficiency",
    "silver_mes_production_orders": "order_id product_code batch_number machine_id operator_id shift plant planned_qty "
    "actual_qty rejected_qty scrap_pct:2 status start_time:ts end_time:ts duration_minutes yield_pct:2 _ingested_at:ts "
    "_row_hash _ingest_year _ingest_month _ingest_day _data_owner",
    "silver_iqms_quality_tests": "test_id batch_number product_code machine_id test_type result_value:4 usl:4 lsl:4 result "
    f"analyst_id equipment_id tested_at:ts approved_by pass_fail_flag deviation_from_mean:4 spec_status {TAIL} _data_owner",
    "silver_iqms_deviations": "deviation_id batch_number product_code defect_code severity description detected_by "
    f"detected_at:ts status root_cause severity_score days_to_close:n is_open {TAIL} _data_owner",
    "silver_trackwise_capas": "capa_id capa_type title description source product_code department owner opened_date:d "
    "target_close_date:d actual_close_date:d status effectiveness_verified days_open:n is_overdue sla_breach_flag "
    f"{TAIL} _data_owner",
    "silver_sap_inventory": "po_number material_code plant storage_location planned_qty:2 actual_qty:2 variance_qty:2 "
    f"closing_stock:2 uom posting_date:d report_month:d cost_center total_cost:2 unit_cost:2 currency {STAMP}",
    "silver_tms_training": "record_id employee_id employee_name department training_name training_category scheduled_date:d "
    "completion_date:d score:2 status trainer_id training_mode validity_months _source _ingested_at:ts",
    "gold_oee_dashboard": "machine_id hour_window:ts product_code total_events pass_count fail_count quality_rate:2 avg_temp:6 "
    "avg_pressure:6 window_start:ts window_end:ts",
    "gold_batch_summary": "batch_id product_code line_id planned_qty:6 actual_qty:6 yield_pct:2 total_cost:4 cost_per_unit:2 "
    "total_deviations critical_deviations batch_status production_start:ts production_end:ts cycle_time_hours:2",
    "gold_quality_kpis": "report_date:d product_code total_batches released_batches rejected_batches right_first_time_pct:2 "
    "avg_yield_pct:2 total_deviations:n critical_deviation_rate:2 avg_resolution_time_hours:2",
    "gold_production_efficiency": "week_start:d line_id total_orders completed_orders avg_yield_pct:2 avg_cost_per_unit:2 "
    "efficiency_category trend_vs_prior_week",
    "gold_manufacturing_oee_mart": "machine_id plant shift production_date:d year month day total_orders total_planned_qty "
    "total_actual_qty total_rejected_qty completed_orders on_hold_orders avg_yield_pct:6 avg_scrap_pct:6 "
    "total_production_minutes availability:4 performance:4 quality_rate:4 oee_score:4 quality_tests_run "
    "quality_tests_passed quality_pass_rate_pct:2 _data_source",
    "gold_quality_risk_mart": "product_code batch_number total_production_orders total_actual_qty total_rejected_qty "
    "avg_yield_pct:6 total_tests passed_tests failed_tests pass_rate:2 total_deviations open_deviations "
    "critical_deviation_count major_deviation_count batch_release_status overall_risk_score:2 risk_rag_status _data_source",
    "gold_compliance_capa_mart": "product_code department report_month:d total_capas closed_capas open_capas overdue_capas "
    "effectiveness_verified_count avg_days_open:6 max_days_open:n closure_rate_pct:2 linked_deviations_critical "
    "compliance_rag_status",
    "gold_sap_inventory_mart": "material_code plant storage_location report_month:d movement_count planned_stock:2 "
    "actual_stock:2 variance_qty:2 closing_stock:2 avg_unit_cost:2 total_cost:2",
    "gold_training_compliance_mart": "department report_month:d total_trainings completed_trainings overdue_trainings "
    "avg_score:2 completion_rate_pct:2 compliance_rag_status",
}

BRONZE = {
    "bronze_mes_events": ("mes_events", "b_mes_events"),
    "bronze_iqms_orders": ("iqms_orders", "b_iqms_orders"),
    "bronze_trackwise_deviations": ("trackwise_deviations", "b_trackwise_deviations"),
    "bronze_sap_orders": ("sap_ecc_orders", "b_sap_ecc_orders"),
    "bronze_sop_documents": ("sop_documents", "b_sop_documents"),
    "bronze_raw_envelope": ("mes_production_orders", "b_mes_production_orders"),
    "bronze_tms": ("tms_training_completions", "b_tms_training"),
}

STORED_FIRST = {
    "gold_batch_summary": ("silver_mes_events", "silver_production_orders", "silver_quality_events"),
    "gold_quality_kpis": ("silver_mes_events", "silver_production_orders", "silver_quality_events", "gold_batch_summary"),
}
AS_OF = {"silver_trackwise_capas": inputs.CAPAS_AS_OF, "gold_compliance_capa_mart": inputs.CAPAS_AS_OF}


def model(spark, sf_dir: str, name: str, as_of: dt.date | None = None, columns: list[str] | None = None):
    """A silver or gold table over the given tables, as one lazy plan. ``columns``: those to be built, of a table made of payloads."""
    when = as_of or AS_OF.get(name, inputs.EVENTS_AS_OF)
    # Tables that several inputs are built from are stored first, as the pipeline does; other plans stay in one piece.
    done = stored_models(spark, sf_dir, *STORED_FIRST[name], as_of=as_of) if name in STORED_FIRST else None
    return registry.build(name, inputs.bronze_tables(spark, sf_dir), inputs.context(when, columns and {name: columns}), done)


def stored(spark, df, label: str):
    """The rows written to the shared folder and read back, for queries that use them several times."""
    path = scratch(spark, label)
    tables.write_layer_table(df, path)
    return spark.read.parquet(path)


def stored_bronze(spark, sf_dir: str, *names: str) -> dict:
    """The bronze tables, of which those named are de-duplicated or parsed once and stored, not once per table built on them."""
    source = inputs.bronze_tables(spark, sf_dir)
    return dict(source) | {name: stored(spark, source[name], name) for name in names}


def stored_models(spark, sf_dir: str, *names: str, as_of: dt.date | None = None, bronze=None) -> dict:
    """Several models, each materialised before the next is built from it, as the pipeline does."""
    done = {}
    bronze = inputs.bronze_tables(spark, sf_dir) if bronze is None else bronze
    for name in names:
        context = inputs.context(as_of or AS_OF.get(name, inputs.EVENTS_AS_OF))
        done[name] = stored(spark, registry.build(name, bronze, context, done), name)
    return done


# Bronze tables that take work and that more than one model, or a model and a count, read.
SHARED = ("mes_events", "iqms_orders", "trackwise_deviations", "sap_ecc_orders", "tms_training_completions")
SHARED_BY_MODELS = ("iqms_orders", "sap_ecc_orders")


def all_models(spark, sf_dir: str) -> dict:
    """All silver and gold tables, each built from the stored ones before it.

    Built for each query: a lake kept from an earlier one would show tables as they were then.
    """
    return stored_models(spark, sf_dir, *in_order(), bronze=stored_bronze(spark, sf_dir, *SHARED_BY_MODELS))


def lake(spark, sf_dir: str) -> dict:
    """Every table of the three layers by its qualified name."""
    source = stored_bronze(spark, sf_dir, *SHARED)
    found = {registry.qualified(n): source[n] for n in registry.BRONZE_TABLES}
    return found | {registry.qualified(n): df for n, df in stored_models(spark, sf_dir, *in_order(), bronze=source).items()}


def bronze_relation(name: str) -> str:
    return "b_tms_training" if name == "tms_training_completions" else f"b_{name}"


LAKE_SQL = {registry.qualified(n): bronze_relation(n) for n in registry.BRONZE_TABLES} | {
    registry.qualified(n): f"{m.layer[0]}_{n.split('_', 1)[1]}" for n, m in registry.MODELS.items()
}


def relation(name: str) -> str:
    layer, _, rest = name.partition("_")
    return f"{layer[0]}_{rest}"


def register() -> None:
    for key, (table, source) in BRONZE.items():
        add(
            key,
            lambda spark, sf, table=table, key=key: present(inputs.bronze_tables(spark, sf)[table], COLUMNS[key]),
            shown(source, COLUMNS[key]),
        )
    for name in registry.MODELS:
        add(
            name,
            lambda spark, sf, name=name: present(model(spark, sf, name), COLUMNS[name]),
            shown(relation(name), COLUMNS[name]),
        )
