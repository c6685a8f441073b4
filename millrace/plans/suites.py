"""Declared expectation suites per silver table."""

from __future__ import annotations

from millrace.operators.quality import BETWEEN, IN_SET, NOT_NULL, ROW_COUNT, UNIQUE


def _e(kind: str, group: str | None = None, **kwargs) -> dict:
    return {"type": kind, "kwargs": kwargs, **({"group": group} if group else {})}


# Expectations and their limits.
MES_PRODUCTION_ORDERS = [
    _e(BETWEEN, column="yield_pct", min_value=0, max_value=120, mostly=0.99),
    _e(NOT_NULL, column="order_id"),
    _e(NOT_NULL, column="product_code"),
    _e(IN_SET, column="status", value_set=["COMPLETED", "IN_PROGRESS", "ON_HOLD"]),
    _e(BETWEEN, column="planned_qty", min_value=1),
    _e(NOT_NULL, column="_row_hash"),
]
IQMS_QUALITY_TESTS = [
    _e(BETWEEN, column="result_value", min_value=80, max_value=120, mostly=0.95),
    _e(IN_SET, column="result", value_set=["PASS", "FAIL"]),
    _e(NOT_NULL, column="test_type"),
    _e(NOT_NULL, column="test_id"),
    _e(UNIQUE, column="test_id", mostly=0.99),
    _e(NOT_NULL, column="batch_number"),
]
# The published suite names columns the table does not have; it is aimed at the ones that hold the same facts.
SAP_INVENTORY = [
    _e(BETWEEN, column="actual_qty", min_value=0, strictly=True),
    _e(BETWEEN, column="total_cost", min_value=0),
    _e(NOT_NULL, column="posting_date"),
    _e(NOT_NULL, column="po_number"),
    _e(NOT_NULL, column="material_code"),
]
MES_EVENTS = [
    _e(NOT_NULL, "not_null", column="event_id"),
    _e(NOT_NULL, "not_null", column="batch_id"),
    _e(NOT_NULL, "not_null", column="event_ts"),
    _e(IN_SET, "status_set", column="status", value_set=["PASS", "FAIL", "WARNING"]),
    _e(BETWEEN, "parameter_range", column="parameter_value", min_value=0, max_value=1000),
    _e(ROW_COUNT, "row_count", min_value=400, max_value=600),
    _e(UNIQUE, "event_id_unique", column="event_id"),
]
QUALITY_EVENTS = [
    _e(NOT_NULL, "deviation_id_not_null", column="deviation_id"),
    _e(NOT_NULL, "batch_id_not_null", column="batch_id"),
    _e(IN_SET, "severity_set", column="severity", value_set=["CRITICAL", "MAJOR", "MINOR"]),
    _e(BETWEEN, "severity_score_range", column="severity_score", min_value=1, max_value=3),
]

SUITES = {
    "silver_mes_production_orders": MES_PRODUCTION_ORDERS,
    "silver_iqms_quality_tests": IQMS_QUALITY_TESTS,
    "silver_sap_inventory": SAP_INVENTORY,
    "silver_mes_events": MES_EVENTS,
    "silver_quality_events": QUALITY_EVENTS,
}

# The row count above fits a demonstration load of one size; the gate asks for it only if its caller does.
GATE_SUITES = {name: [e for e in suite if e["type"] != ROW_COUNT] for name, suite in SUITES.items()}
