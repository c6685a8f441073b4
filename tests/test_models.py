"""Silver and gold on small literal tables: thresholds, missing values, fan-outs, empty inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import days, quality, tables
from millrace.plans import bronze, gold, registry, schemas, silver
from millrace.plans.pipeline import in_order, run_pipeline, update_incremental
from millrace.session import scratch


def now():
    """A column needs a running session, so this is no constant."""
    return F.lit(dt.datetime(2024, 2, 1))


AS_OF = dt.date(2024, 2, 1)
T = dt.datetime


def stamped(spark, schema, rows):
    df = spark.createDataFrame(rows, schema)
    return bronze.with_metadata(df, "S", "csv_seed", now())


def mes(spark, *rows):
    base = ("M1", "B1", "API-100", "temperature", 20.0, "C", "OP", "A", T(2024, 1, 1, 10), "pass")
    names = schemas.MES_EVENTS.fieldNames()[1:]
    filled = []
    for i, changes in enumerate(rows):
        row = dict(zip(names, base)) | changes
        filled.append((f"E{i}", *[row[n] for n in names]))
    return stamped(spark, schemas.MES_EVENTS, filled)


def orders(spark, *rows):
    base = {
        "product_code": "API-100",
        "batch_id": "B1",
        "quantity": 10,
        "uom": "KG",
        "planned_start": T(2024, 1, 1),
        "actual_start": T(2024, 1, 1, 5),
        "actual_end": None,
        "status": "complete",
        "line_id": "L1",
    }
    filled = [(f"O{i}", *[(base | changes)[n] for n in schemas.IQMS_ORDERS.fieldNames()[1:]]) for i, changes in enumerate(rows)]
    return stamped(spark, schemas.IQMS_ORDERS, filled)


def envelope(spark, payloads, topic="mes.production_orders"):
    rows = [(b"k", json.dumps(p).encode() if not isinstance(p, str) else p.encode(), topic, 0, i, T(2024, 1, 1)) for i, p in enumerate(payloads)]
    return bronze.raw_envelope(spark.createDataFrame(rows, schemas.KAFKA_RECORD), now())


@pytest.mark.parametrize(
    "name, value, verdict",
    [
        ("temperature", 15.0, "PASS"),
        ("temperature", 14.99, "FAIL"),
        ("temperature", 35.0, "PASS"),
        ("pressure", 0.5, "PASS"),
        ("pressure", 10.01, "FAIL"),
        ("ph_level", 6.5, "PASS"),
        ("ph_level", 8.51, "FAIL"),
        ("rpm", -5.0, "PASS"),
        ("temperature", None, "FAIL"),
        (None, 20.0, "FAIL"),
    ],
)
def test_range_verdict(spark, name, value, verdict):
    built = silver.mes_events(mes(spark, {"parameter_name": name, "parameter_value": value}), orders(spark, {}))
    assert built.first()["dq_status"] == verdict


def test_mes_events_defaults_and_latest_order(spark):
    rows = mes(
        spark,
        {"unit": None, "operator_id": None, "shift": None, "status": None, "parameter_value": 5000.0, "product_code": "X"},
        {"batch_id": "none"},
        {"batch_id": None},
    )
    started = orders(spark, {}, {"actual_start": None, "planned_start": T(2024, 1, 3), "status": None}, {"actual_start": T(2024, 1, 2)})
    got = {r["event_id"]: r for r in silver.mes_events(rows, started).collect()}
    first = got["E0"]
    assert (first["unit"], first["operator_id"], first["shift"], first["status"]) == ("UNKNOWN", "UNASSIGNED", "UNKNOWN", "WARNING")
    assert first["parameter_value"] == 1000.0 and first["product_name"] == "Unknown Product"
    assert first["order_id"] == "O1" and first["order_status"] == "PLANNED"
    assert got["E1"]["order_id"] is None and got["E2"]["order_id"] is None and len(got) == 3


def deviation(number, batch="B1", **changes):
    base = {
        "deviation_id": f"D{number}",
        "batch_id": batch,
        "product_code": "API-100",
        "deviation_type": "t",
        "severity": "major",
        "description": "d",
        "reported_by": "r",
        "reported_ts": T(2024, 1, 2),
        "status": "OPEN",
        "resolution_ts": None,
    } | changes
    return tuple(base[n] for n in schemas.TRACKWISE_DEVIATIONS.fieldNames())


def silver_set(spark, deviations):
    events = silver.mes_events(mes(spark, {}, {"event_ts": T(2024, 1, 1, 12)}), orders(spark, {}))
    return events, silver.quality_events(events, stamped(spark, schemas.TRACKWISE_DEVIATIONS, deviations))


def test_quality_events(spark):
    _, built = silver_set(
        spark,
        [deviation(1), deviation(2, resolution_ts=T(2024, 1, 2, 1, 30), severity="critical"), deviation(3, batch="other"), deviation(4, batch=None)],
    )
    got = {r["deviation_id"]: r for r in built.collect()}
    assert set(got) == {"D1", "D2"}
    assert got["D1"]["is_open_deviation"] and got["D1"]["time_to_resolution_hours"] is None and got["D1"]["severity_score"] == 2
    assert got["D2"]["time_to_resolution_hours"] == 1.5 and got["D2"]["severity_score"] == 3 and got["D2"]["mes_event_count"] == 2


def sap(spark, *rows):
    base = {
        "material_code": "MAT-100",
        "plant": "P",
        "storage_location": "S",
        "planned_qty": 100,
        "actual_qty": 95,
        "uom": "KG",
        "posting_date": dt.date(2024, 1, 1),
        "cost_center": "C",
        "total_cost": 190.0,
        "currency": "INR",
    }
    filled = [(f"P{i}", *[(base | c)[n] for n in schemas.SAP_ECC_ORDERS.fieldNames()[1:]]) for i, c in enumerate(rows)]
    return stamped(spark, schemas.SAP_ECC_ORDERS, filled)


@pytest.mark.parametrize("actual, label", [(95, "HIGH"), (94, "MEDIUM"), (85, "MEDIUM"), (84, "LOW"), (None, "LOW")])
def test_production_efficiency_limits(spark, actual, label):
    row = silver.production_orders(orders(spark, {}), sap(spark, {"actual_qty": actual})).first()
    assert row["production_efficiency"] == label
    assert row["yield"] == float(actual or 0) and row["actual_qty"] == (actual if actual is not None else 10)
    assert row["cost_per_unit"] == (None if actual is None else round(190 / actual, 2))


def test_orders_without_stock_profile(spark):
    row = silver.production_orders(orders(spark, {"product_code": "API-999"}), sap(spark, {})).first()
    assert row["planned_qty"] == 10 and row["yield"] is None and row["production_efficiency"] == "LOW"


def test_zero_planned_quantity_gives_no_yield(spark):
    row = silver.production_orders(orders(spark, {}), sap(spark, {"planned_qty": 0})).first()
    assert row["yield"] is None and row["production_efficiency"] == "LOW"


def test_payload_orders(spark):
    base = {"order_id": "A", "product_code": "p", "planned_qty": 100, "actual_qty": 90, "start_time": "2024-01-01T00:00:30", "end_time": "2024-01-01T01:00:29", "status": " completed"}
    payloads = [base, base | {"actual_qty": 80}, base | {"order_id": None}, base | {"order_id": "B", "actual_qty": -1}, base | {"order_id": "C", "planned_qty": 0}, base | {"order_id": "D", "actual_qty": "many"}, "{broken"]
    got = silver.mes_production_orders(envelope(spark, payloads), now()).collect()
    assert len(got) == 1
    assert got[0]["yield_pct"] == 80.0 and got[0]["duration_minutes"] == 59 and got[0]["status"] == "COMPLETED" and got[0]["scrap_pct"] == 0.0


def test_quality_test_limits(spark):
    base = {"test_id": "1", "result_value": 105, "usl": 105.0, "lsl": 95.0, "result": "Pass "}
    payloads = [base, base | {"test_id": "2", "result_value": 105.01}, base | {"test_id": "3", "result_value": 94}, base | {"test_id": "4", "usl": None, "lsl": None, "result_value": 1000}, base | {"test_id": "5", "result_value": "n/a"}]
    got = {r["test_id"]: r for r in silver.iqms_quality_tests(envelope(spark, payloads, "iqms.quality_tests"), now()).collect()}
    assert {k: r["spec_status"] for k, r in got.items()} == {"1": "WITHIN_SPEC", "2": "ABOVE_USL", "3": "BELOW_LSL", "4": "WITHIN_SPEC"}
    assert got["1"]["pass_fail_flag"] and got["1"]["deviation_from_mean"] == 0.05


@pytest.mark.parametrize(
    ("name", "table", "key", "payload"),
    [
        (
            "silver_mes_production_orders",
            "mes_production_orders",
            "order_id",
            {"product_code": "p", "batch_number": "B", "machine_id": "M", "operator_id": "O", "shift": "a", "plant": "P1", "planned_qty": 100, "actual_qty": 90, "rejected_qty": 3, "scrap_percentage": 1.25, "status": "on_hold ", "start_time": "2024-01-01T00:00:00", "end_time": "2024-01-01T02:30:00"},
        ),
        (
            "silver_iqms_quality_tests",
            "iqms_quality_tests",
            "test_id",
            {"batch_number": "B", "product_code": "p", "machine_id": "M", "test_type": " assay", "result_value": 106, "usl": 105, "lsl": 95, "result": "pass", "analyst_id": "A", "equipment_id": "E", "tested_at": "2024-01-01T00:00:00", "approved_by": "C"},
        ),
        (
            "silver_iqms_deviations",
            "iqms_deviations",
            "deviation_id",
            {"batch_number": "B", "product_code": "p", "defect_code": "D", "severity": "major", "description": "d", "detected_by": "O", "detected_at": "2024-01-01T00:00:00", "status": "closed", "root_cause": "r"},
        ),
        (
            "silver_trackwise_capas",
            "trackwise_capas",
            "capa_id",
            {"capa_type": "t", "title": "x", "description": "d", "source": "s", "product_code": "p", "department": "q", "owner": "o", "opened_date": "2020-01-01", "target_close_date": "2020-02-01", "actual_close_date": "2020-09-01", "status": "closed", "effectiveness_verified": "true"},
        ),
    ],
)
def test_wanted_columns_are_those_of_the_whole_table(spark, name, table, key, payload):
    """Any one column alone, and the rows behind it, are as in the table with all columns; other fields are not read."""
    usable = payload | {key: "1"}
    payloads = [usable, usable | {"batch_number": "old", "product_code": "q"}, payload | {key: "2"}, payload, "{broken", usable | {key: "{3}"}, usable | {key: {"a": 4}}]
    payloads += [usable | {key: "5", field: None} for field in payload]
    raw = envelope(spark, payloads)

    def built(columns=None):
        context = registry.Context(as_of=AS_OF, loaded_at=now(), columns={name: columns} if columns else {})
        return registry.build(name, {table: raw}, context)

    whole = built()
    rows = whole.collect()
    assert {r[key] for r in rows} >= {"1", "2", "{3}"}
    plans = []
    for column in whole.columns:
        alone = built([column])
        assert alone.columns == [column]
        assert sorted(map(repr, (r[0] for r in alone.collect()))) == sorted(repr(r[column]) for r in rows), column
        plans.append(alone._jdf.queryExecution().optimizedPlan().toString().split("json_tuple(")[1].split(")")[0])
    assert max(len(p.split(",")) for p in plans) < len(payload)


def test_capas(spark):
    payloads = [
        {"capa_id": "1", "opened_date": "2023-11-01T00:00:00", "target_close_date": "2024-01-31", "status": "open"},
        {"capa_id": "2", "opened_date": "2023-11-03", "target_close_date": "2024-02-01", "effectiveness_verified": True},
        {"capa_id": "3", "opened_date": "2023-01-01", "actual_close_date": "2023-04-01"},
        {"capa_id": "3", "opened_date": "2023-01-01", "actual_close_date": "2023-04-02"},
        {"capa_id": "4"},
    ]
    raw = envelope(spark, payloads, "trackwise.capas")
    got = sorted(silver.trackwise_capas(raw, AS_OF, now()).select("capa_id", "days_open", "is_overdue", "sla_breach_flag", "effectiveness_verified").collect())
    assert [tuple(r) for r in got] == [
        ("1", 92, True, True, False),
        ("2", 90, False, False, True),
        ("3", 90, False, False, False),
        ("3", 91, False, True, False),
        ("4", None, False, False, False),
    ]
    assert silver.trackwise_capas(raw, AS_OF, now(), latest_by_key=True).count() == 4


def test_inventory_missing_and_negative_quantities(spark):
    rows = silver.sap_inventory(sap(spark, {"actual_qty": None}, {"actual_qty": -5}, {"actual_qty": 0})).orderBy("po_number").collect()
    assert [(r["closing_stock"], r["variance_qty"], r["unit_cost"]) for r in rows] == [(None, None, None), (0.0, -105.0, -38.0), (0.0, -100.0, None)]
    assert rows[0]["report_month"] == dt.date(2024, 1, 1)


def test_batch_status_and_kpi_fan_out(spark):
    events, deviations = silver_set(
        spark, [deviation(1, severity="minor"), deviation(2, severity="minor", reported_ts=T(2024, 1, 3)), deviation(3, reported_ts=T(2024, 1, 3, 1))]
    )
    batches = gold.batch_summary(events, silver.production_orders(orders(spark, {}), sap(spark, {})), deviations)
    row = batches.first()
    assert row["batch_status"] == "UNDER_REVIEW" and row["total_deviations"] == 3 and row["cycle_time_hours"] == 2.0
    # Reported on two days: the batch counts twice.
    kpi = gold.quality_kpis(batches, deviations).first()
    assert kpi["total_batches"] == 2 and kpi["total_deviations"] == 6 and kpi["right_first_time_pct"] == 0.0


def test_weekly_trend(spark):
    weeks = [T(2024, 1, 1), T(2024, 1, 8), T(2024, 1, 15), T(2024, 1, 22)]
    rows = [(f"O{i}", w, "L", "COMPLETE", y, 1.0) for i, (w, y) in enumerate(zip(weeks, [90.0, 95.0, 95.0, 80.0]))]
    df = spark.createDataFrame(rows, "order_id string, actual_start timestamp, line_id string, status string, yield double, cost_per_unit double")
    got = gold.production_efficiency(df).orderBy("week_start").collect()
    assert [r["trend_vs_prior_week"] for r in got] == ["STABLE", "IMPROVING", "STABLE", "DECLINING"]
    assert [r["efficiency_category"] for r in got] == ["MEDIUM", "HIGH", "HIGH", "LOW"]


def risk(spark, made, tested, deviating):
    o = spark.createDataFrame(made, "product_code string, batch_number string, actual_qty int, rejected_qty int, yield_pct double")
    t = spark.createDataFrame(tested, "product_code string, batch_number string, pass_fail_flag boolean")
    d = spark.createDataFrame(deviating, "product_code string, batch_number string, severity string, is_open boolean")
    return {(r["product_code"], r["batch_number"]): r for r in gold.quality_risk(o, t, d, now()).collect()}


def test_risk_mart(spark):
    tests = [("p", "b1", True)] * 19 + [("p", "b1", False)] + [("p", "b2", True)] * 79 + [("p", "b2", False)] * 21 + [("p", "b3", True)] * 4 + [("p", "b3", False)]
    got = risk(
        spark,
        [("p", "b1", 1, 0, 84.99), ("p", "b1", 1, 1, 84.99), ("p", "b4", 5, 0, 90.0)],
        tests,
        [("p", "b3", "MINOR", False), ("p", "b5", "CRITICAL", True), (None, "b1", "MAJOR", False)],
    )
    assert {k: r["batch_release_status"] for k, r in got.items()} == {
        ("p", "b1"): "PASS",
        ("p", "b2"): "FAIL",
        ("p", "b3"): "PENDING",
        ("p", "b4"): "PENDING",
        ("p", "b5"): "PENDING",
        (None, "b1"): "PENDING",
    }
    assert got["p", "b1"]["overall_risk_score"] == 20.0 and got["p", "b1"]["risk_rag_status"] == "GREEN"
    assert got["p", "b2"]["risk_rag_status"] == "AMBER" and got["p", "b3"]["overall_risk_score"] == 23.0
    assert got["p", "b5"]["risk_rag_status"] == "RED" and got["p", "b5"]["overall_risk_score"] == 70.0
    assert got["p", "b4"]["overall_risk_score"] == 50.0 and got["p", "b4"]["avg_yield_pct"] == 90.0


def test_risk_mart_keeps_rows_without_keys(spark):
    got = risk(spark, [(None, "b", 1, 0, 100.0)], [(None, "b", True)], [])
    assert len(got) == 1  # same printed key, but two rows
    o = gold.quality_risk(
        spark.createDataFrame([(None, "b", 1, 0, 100.0)], "product_code string, batch_number string, actual_qty int, rejected_qty int, yield_pct double"),
        spark.createDataFrame([(None, "b", True)], "product_code string, batch_number string, pass_fail_flag boolean"),
        spark.createDataFrame([], "product_code string, batch_number string, severity string, is_open boolean"),
        now(),
    )
    assert o.count() == 2


@pytest.mark.parametrize("done, light", [(19, "GREEN"), (18, "AMBER"), (16, "AMBER"), (15, "RED")])
def test_training_lights(spark, done, light):
    rows = [("QA", dt.date(2024, 1, i + 1), 80.0, "COMPLETED" if i < done else "OVERDUE") for i in range(20)]
    df = spark.createDataFrame(rows, "department string, scheduled_date date, score double, status string")
    row = gold.training_compliance(df, now()).first()
    assert row["compliance_rag_status"] == light and row["overdue_trainings"] == 20 - done


def test_oee_without_tests(spark):
    payload = {"order_id": "A", "product_code": "p", "machine_id": "M", "planned_qty": 100, "actual_qty": 90, "start_time": "2024-01-01T00:00:00", "status": "COMPLETED"}
    made = silver.mes_production_orders(envelope(spark, [payload, payload | {"order_id": "B", "status": "ON_HOLD"}, payload | {"order_id": "C", "start_time": None}]), now())
    tests = silver.iqms_quality_tests(envelope(spark, [], "iqms.quality_tests"), now())
    row = gold.manufacturing_oee(made, tests, now()).first()
    assert row["availability"] == 0.5 and row["performance"] == 0.9 and row["oee_score"] == 0.0 and row["quality_tests_run"] == 0


def empty_bronze(spark):
    typed = {
        "mes_events": schemas.MES_EVENTS,
        "iqms_orders": schemas.IQMS_ORDERS,
        "trackwise_deviations": schemas.TRACKWISE_DEVIATIONS,
        "sap_ecc_orders": schemas.SAP_ECC_ORDERS,
        "sop_documents": schemas.SOP_DOCUMENTS,
    }
    tables_ = {n: bronze.with_metadata(spark.createDataFrame([], s), "S", "f", now()) for n, s in typed.items()}
    return tables_ | {n: spark.createDataFrame([], s) for n, s in schemas.PLACEHOLDERS.items()}


def test_every_model_builds_on_empty_inputs(spark):
    context = registry.Context(AS_OF, now())
    for name in registry.MODELS:
        assert registry.build(name, empty_bronze(spark), context).count() == 0, name


def test_models_come_after_their_inputs():
    order = in_order()
    assert len(order) == 18
    for name in order:
        assert all(order.index(i) < order.index(name) for i in registry.MODELS[name].inputs if i in registry.MODELS)


def small_bronze(spark):
    return empty_bronze(spark) | {
        "mes_events": mes(spark, {}, {"event_ts": T(2024, 1, 2)}),
        "iqms_orders": orders(spark, {}),
        "sap_ecc_orders": sap(spark, {}),
        "trackwise_deviations": stamped(spark, schemas.TRACKWISE_DEVIATIONS, [deviation(1)]),
    }


def test_pipeline_publishes_gold_only_behind_the_gate(spark):
    root = scratch(spark, "lake")
    bad = [{"type": quality.ROW_COUNT, "kwargs": {"min_value": 400, "max_value": 600}}]
    closed = run_pipeline(spark, root, small_bronze(spark), AS_OF, T(2024, 2, 1), {"silver_mes_events": bad})
    assert not closed.passed and not any(n.startswith("gold") for n in closed.published)
    kept = scratch(spark, "results")
    opened = run_pipeline(spark, root, small_bronze(spark), AS_OF, T(2024, 2, 2), {}, results_path=kept)
    assert spark.read.json(f"{kept}/at=20240202T000000/silver/silver_mes_events").where("success").count() == 4
    assert opened.passed and len(opened.published) == 18
    assert tables.read_as_of(spark, root, "gold", "gold_batch_summary").first()["batch_status"] == "UNDER_REVIEW"


def test_incremental_update(spark):
    path = scratch(spark, "incremental")
    context = registry.Context(AS_OF, now())
    update_incremental(spark, path, "silver_mes_events", small_bronze(spark), context)
    later = small_bronze(spark) | {
        "mes_events": mes(spark, {"event_ts": T(2023, 12, 31)}, {"event_ts": T(2024, 1, 2), "status": "fail"}, {"event_ts": T(2024, 1, 5)})
    }
    update_incremental(spark, path, "silver_mes_events", later, context)
    got = {r["event_id"]: (r["event_ts"], r["status"]) for r in days.read_days(spark, path).collect()}
    # The first event is older than the newest stored one, so its late change is not picked up.
    assert got == {"E0": (T(2024, 1, 1, 10), "PASS"), "E1": (T(2024, 1, 2), "FAIL"), "E2": (T(2024, 1, 5), "PASS")}
