"""The models: what each table is built from, its key, its checks and how it is kept."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from millrace.plans import gold, silver


@dataclass(frozen=True)
class Context:
    """Values a run fixes once, so results do not depend on the clock.

    ``columns``: of models built from payloads, the columns somebody reads; all of those not named.
    """

    as_of: dt.date
    loaded_at: Column
    columns: Mapping[str, Sequence[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    name: str
    layer: str
    inputs: tuple[str, ...]
    build: Callable[[Mapping[str, DataFrame], Context], DataFrame]
    key: tuple[str, ...] = ()
    incremental_on: str | None = None
    checks: tuple[dict, ...] = field(default=())


BRONZE_TABLES = (
    "mes_events",
    "mes_production_orders",
    "iqms_deviations",
    "iqms_orders",
    "iqms_quality_tests",
    "tms_training_completions",
    "trackwise_capas",
    "trackwise_deviations",
    "sap_ecc_orders",
    "sop_documents",
)


def _required(*columns: str) -> tuple[dict, ...]:
    return tuple({"check": "not_null", "column": c} for c in columns)


def _unique(column: str) -> tuple[dict, ...]:
    return ({"check": "not_null", "column": column}, {"check": "unique", "column": column})


def _one_of(column: str, *values: str) -> tuple[dict, ...]:
    return ({"check": "accepted_values", "column": column, "values": list(values)},)


def _refers(column: str, to: str, field_name: str) -> tuple[dict, ...]:
    return ({"check": "relationships", "column": column, "to": to, "field": field_name},)


_LIGHTS = ("GREEN", "AMBER", "RED")

# Dependencies, keys and column checks of the tables.
MODELS: dict[str, Model] = {
    m.name: m
    for m in [
        Model(
            "silver_mes_events",
            "silver",
            ("mes_events", "iqms_orders"),
            lambda t, c: silver.mes_events(t["mes_events"], t["iqms_orders"]),
            ("event_id",),
            "event_ts",
            _unique("event_id") + _required("batch_id") + _one_of("status", "PASS", "FAIL", "WARNING"),
        ),
        Model(
            "silver_production_orders",
            "silver",
            ("iqms_orders", "sap_ecc_orders"),
            lambda t, c: silver.production_orders(t["iqms_orders"], t["sap_ecc_orders"]),
            ("order_id",),
            None,
            _unique("order_id")
            + _required("batch_id")
            + _refers("product_code", "silver_mes_events", "product_code")
            + _one_of("status", "PLANNED", "IN_PROGRESS", "COMPLETE", "DELAYED")
            + _one_of("production_efficiency", "HIGH", "MEDIUM", "LOW"),
        ),
        Model(
            "silver_quality_events",
            "silver",
            ("silver_mes_events", "trackwise_deviations"),
            lambda t, c: silver.quality_events(t["silver_mes_events"], t["trackwise_deviations"]),
            ("deviation_id",),
            None,
            _unique("deviation_id")
            + _required("batch_id")
            + _refers("batch_id", "silver_mes_events", "batch_id")
            + _one_of("status", "OPEN", "IN_REVIEW", "CLOSED")
            + _one_of("severity", "CRITICAL", "MAJOR", "MINOR"),
        ),
        Model(
            "silver_mes_production_orders",
            "silver",
            ("mes_production_orders",),
            lambda t, c: silver.mes_production_orders(
                t["mes_production_orders"], c.loaded_at, c.columns.get("silver_mes_production_orders")
            ),
            ("order_id",),
            None,
            _unique("order_id") + _one_of("status", "COMPLETED", "IN_PROGRESS", "ON_HOLD"),
        ),
        Model(
            "silver_iqms_quality_tests",
            "silver",
            ("iqms_quality_tests",),
            lambda t, c: silver.iqms_quality_tests(
                t["iqms_quality_tests"], c.loaded_at, c.columns.get("silver_iqms_quality_tests")
            ),
            ("test_id",),
            None,
            _unique("test_id") + _one_of("result", "PASS", "FAIL"),
        ),
        Model(
            "silver_iqms_deviations",
            "silver",
            ("iqms_deviations",),
            lambda t, c: silver.iqms_deviations(
                t["iqms_deviations"], c.as_of, c.loaded_at, c.columns.get("silver_iqms_deviations")
            ),
            ("deviation_id",),
            None,
            _unique("deviation_id") + _one_of("severity", "CRITICAL", "MAJOR", "MINOR"),
        ),
        Model(
            "silver_trackwise_capas",
            "silver",
            ("trackwise_capas",),
            lambda t, c: silver.trackwise_capas(
                t["trackwise_capas"], c.as_of, c.loaded_at, columns=c.columns.get("silver_trackwise_capas")
            ),
            ("capa_id",),
            None,
            _unique("capa_id") + _one_of("status", "OPEN", "IN_PROGRESS", "COMPLETED", "VERIFIED", "CLOSED"),
        ),
        Model(
            "silver_sap_inventory",
            "silver",
            ("sap_ecc_orders",),
            lambda t, c: silver.sap_inventory(t["sap_ecc_orders"]),
            ("po_number",),
            None,
            _required("material_code", "plant"),
        ),
        Model(
            "silver_tms_training",
            "silver",
            ("tms_training_completions",),
            lambda t, c: silver.tms_training(t["tms_training_completions"]),
            ("record_id",),
            None,
            _unique("record_id")
            + _required("department")
            + _one_of("status", "COMPLETED", "SCHEDULED", "IN_PROGRESS", "OVERDUE"),
        ),
        Model(
            "gold_oee_dashboard",
            "gold",
            ("silver_mes_events",),
            lambda t, c: gold.oee_dashboard(t["silver_mes_events"]),
            ("machine_id", "hour_window", "product_code"),
            None,
            _required("machine_id", "hour_window"),
        ),
        Model(
            "gold_batch_summary",
            "gold",
            ("silver_mes_events", "silver_production_orders", "silver_quality_events"),
            lambda t, c: gold.batch_summary(
                t["silver_mes_events"], t["silver_production_orders"], t["silver_quality_events"]
            ),
            ("batch_id",),
            None,
            _unique("batch_id") + _one_of("batch_status", "RELEASED", "REJECTED", "UNDER_REVIEW"),
        ),
        Model(
            "gold_quality_kpis",
            "gold",
            ("gold_batch_summary", "silver_quality_events"),
            lambda t, c: gold.quality_kpis(t["gold_batch_summary"], t["silver_quality_events"]),
            ("report_date", "product_code"),
            None,
            _required("report_date", "product_code"),
        ),
        Model(
            "gold_production_efficiency",
            "gold",
            ("silver_production_orders",),
            lambda t, c: gold.production_efficiency(t["silver_production_orders"]),
            ("week_start", "line_id"),
            None,
            _required("week_start", "line_id")
            + _one_of("efficiency_category", "HIGH", "MEDIUM", "LOW")
            + _one_of("trend_vs_prior_week", "IMPROVING", "DECLINING", "STABLE"),
        ),
        Model(
            "gold_manufacturing_oee_mart",
            "gold",
            ("silver_mes_production_orders", "silver_iqms_quality_tests"),
            lambda t, c: gold.manufacturing_oee(
                t["silver_mes_production_orders"], t["silver_iqms_quality_tests"], c.loaded_at
            ),
            ("machine_id", "plant", "shift", "production_date", "year", "month", "day"),
            None,
            _required("machine_id", "production_date"),
        ),
        Model(
            "gold_quality_risk_mart",
            "gold",
            ("silver_mes_production_orders", "silver_iqms_quality_tests", "silver_iqms_deviations"),
            lambda t, c: gold.quality_risk(
                t["silver_mes_production_orders"],
                t["silver_iqms_quality_tests"],
                t["silver_iqms_deviations"],
                c.loaded_at,
            ),
            ("product_code", "batch_number"),
            None,
            _required("product_code", "batch_number") + _one_of("risk_rag_status", *_LIGHTS),
        ),
        Model(
            "gold_compliance_capa_mart",
            "gold",
            ("silver_trackwise_capas", "silver_iqms_deviations"),
            lambda t, c: gold.compliance_capa(
                t["silver_trackwise_capas"], t["silver_iqms_deviations"], c.as_of, c.loaded_at
            ),
            ("product_code", "department", "report_month"),
            None,
            _required("department") + _one_of("compliance_rag_status", *_LIGHTS),
        ),
        Model(
            "gold_sap_inventory_mart",
            "gold",
            ("silver_sap_inventory",),
            lambda t, c: gold.sap_inventory(t["silver_sap_inventory"], c.loaded_at),
            ("material_code", "plant", "storage_location", "report_month"),
            None,
            _required("material_code", "plant"),
        ),
        Model(
            "gold_training_compliance_mart",
            "gold",
            ("silver_tms_training",),
            lambda t, c: gold.training_compliance(t["silver_tms_training"], c.loaded_at),
            ("department", "report_month"),
            None,
            _required("department", "completion_rate_pct"),
        ),
    ]
}


def layer_of(table: str) -> str:
    return MODELS[table].layer if table in MODELS else "bronze"


def qualified(table: str) -> str:
    return f"{layer_of(table)}.{table}"


def build(name: str, bronze: Mapping[str, DataFrame], context: Context, _done: dict[str, DataFrame] | None = None) -> DataFrame:
    """One model as a single lazy plan over bronze tables, its upstream models included."""
    done = {} if _done is None else _done
    if name in bronze:
        return bronze[name]
    if name not in done:
        model = MODELS[name]
        tables = {i: build(i, bronze, context, done) for i in model.inputs}
        done[name] = model.build(tables, context)
    return done[name]
