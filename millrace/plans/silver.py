"""Silver: cleaned, typed, de-duplicated and enriched tables. One function per table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import (
    cap_at,
    complete_units,
    iso_timestamp,
    month_start,
    ratio,
    severity_score,
    upper_trim,
    with_json_fields,
)
from millrace.operators.dedup import keep_latest
from millrace.operators.lookup import lookup_join
from millrace.operators.nearest import nearest_dated

# Names of the known products.
PRODUCT_NAMES = {
    "API-100": "Paracetamol 500mg",
    "API-200": "Amoxicillin 250mg",
    "API-300": "Cetirizine 10mg",
    "API-400": "Metformin 500mg",
    "API-500": "Omeprazole 20mg",
}
UNKNOWN_PRODUCT = "Unknown Product"

# Accepted range per monitored parameter; other parameters always pass.
PARAMETER_RANGES = {"temperature": (15.0, 35.0), "pressure": (0.5, 10.0), "ph_level": (6.5, 8.5)}
PARAMETER_CAP = 1000.0

# Yield ratios from which an order counts as highly or fairly efficient.
HIGH_YIELD, FAIR_YIELD = 0.95, 0.85

DATA_OWNER = "Enterprise-Data-Engineering"
SLA_DAYS = 90

_ENVELOPE_TAIL = [
    "_ingested_at",
    "_row_hash",
    "_kafka_offset",
    "_source_system",
    "_ingest_year",
    "_ingest_month",
    "_ingest_day",
]
# Newest ingest first; equal times go to the later offset, then to the smaller hash.
_NEWEST = ["_ingested_at", "_kafka_offset"]


def product_name(code: Column) -> Column:
    name = F.lit(UNKNOWN_PRODUCT)
    for known, label in PRODUCT_NAMES.items():
        name = F.when(code == known, F.lit(label)).otherwise(name)
    return name


def range_check(parameter: Column, value: Column) -> Column:
    """PASS inside the parameter's range or for unmonitored parameters, else FAIL (also for a missing name)."""
    ok = ~parameter.isin(*PARAMETER_RANGES)
    for name, (low, high) in PARAMETER_RANGES.items():
        ok = ok | ((parameter == name) & value.between(low, high))
    return F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL"))


def _loaded(loaded_at: Column | None) -> list[Column]:
    return [(loaded_at if loaded_at is not None else F.current_timestamp()).alias("_silver_loaded_at")]


def latest_order_per_batch(orders: DataFrame) -> DataFrame:
    """The most recently started (else planned) order of every batch."""
    typed = orders.where(F.col("batch_id").isNotNull()).select(
        "batch_id",
        "order_id",
        "line_id",
        F.col("quantity").cast("int").alias("planned_quantity"),
        F.col("uom").alias("order_uom"),
        "planned_start",
        "actual_start",
        "actual_end",
        F.upper(F.coalesce("status", F.lit("PLANNED"))).alias("order_status"),
    )
    return keep_latest(typed, ["batch_id"], [F.coalesce("actual_start", "planned_start"), F.col("order_id")])


def mes_events(mes: DataFrame, orders: DataFrame) -> DataFrame:
    """Machine events with product name, defaults, capped value, batch order and range verdict."""
    enriched = lookup_join(mes, latest_order_per_batch(orders), ["batch_id"])
    cleaned = enriched.select(
        "event_id",
        "machine_id",
        "batch_id",
        "product_code",
        product_name(F.col("product_code")).alias("product_name"),
        "parameter_name",
        cap_at(F.col("parameter_value").cast("double"), PARAMETER_CAP).alias("parameter_value"),
        F.coalesce("unit", F.lit("UNKNOWN")).alias("unit"),
        F.coalesce("operator_id", F.lit("UNASSIGNED")).alias("operator_id"),
        F.coalesce("shift", F.lit("UNKNOWN")).alias("shift"),
        "event_ts",
        F.upper(F.coalesce("status", F.lit("WARNING"))).alias("status"),
        "order_id",
        "line_id",
        "planned_quantity",
        "order_uom",
        "planned_start",
        "actual_start",
        "actual_end",
        "order_status",
        "_source",
        "_ingested_at",
        "_nifi_flow",
    )
    verdict = range_check(F.col("parameter_name"), F.col("parameter_value"))
    return cleaned.withColumn("dq_status", verdict)


def batch_events(mes: DataFrame) -> DataFrame:
    """Event history per batch; of several products, names or lines the smallest stands for the batch.

    Text cannot be kept in a hash aggregation's buffer, so asking for the smallest text of
    each batch at once would sort all events. Texts are grouping keys first, which hashes
    the events; only the few combinations per batch are then sorted.
    """
    combos = mes.groupBy("batch_id", "product_code", "product_name", "line_id").agg(
        F.min("event_ts").alias("first_event_ts"),
        F.max("event_ts").alias("last_event_ts"),
        F.count(F.lit(1)).alias("mes_event_count"),
        F.count_if(F.col("status") == "FAIL").alias("mes_fail_count"),
        F.count_if(F.col("dq_status") == "FAIL").alias("dq_fail_count"),
    )
    counts = ("mes_event_count", "mes_fail_count", "dq_fail_count")
    return combos.groupBy("batch_id").agg(
        *[F.min(c).alias(c) for c in ("product_code", "product_name", "line_id", "first_event_ts")],
        F.max("last_event_ts").alias("last_event_ts"),
        *[F.sum(c).alias(c) for c in counts],
    )


def quality_events(mes: DataFrame, deviations: DataFrame) -> DataFrame:
    """Deviations of known batches with the batch's event history, severity points and resolution time."""
    batches = batch_events(mes).select(
        "batch_id",
        "first_event_ts",
        "last_event_ts",
        F.col("product_code").alias("_mes_product"),
        "product_name",
        "line_id",
        "mes_event_count",
        "mes_fail_count",
    )
    upper_cased = deviations.withColumns({"severity": F.upper("severity"), "status": F.upper("status")})
    both = lookup_join(upper_cased, batches, ["batch_id"], "inner")
    resolution_seconds = complete_units("SECOND", F.col("reported_ts"), F.col("resolution_ts"))
    return both.select(
        "deviation_id",
        "batch_id",
        F.coalesce("_mes_product", "product_code").alias("product_code"),
        "product_name",
        "line_id",
        "deviation_type",
        "severity",
        "description",
        "reported_by",
        "reported_ts",
        "status",
        "resolution_ts",
        "first_event_ts",
        "last_event_ts",
        "mes_event_count",
        "mes_fail_count",
        severity_score(F.col("severity")).alias("severity_score"),
        (resolution_seconds / F.lit(3600.0)).alias("time_to_resolution_hours"),
        F.col("resolution_ts").isNull().alias("is_open_deviation"),
        "_source",
        "_ingested_at",
        "_nifi_flow",
    )


def stock_profiles(sap: DataFrame) -> DataFrame:
    """Average order figures per product, plant and storage location; the smallest text stands for several.

    Texts are grouping keys first, for the reason given at ``batch_events``.
    """
    keys = ["product_code", "plant", "storage_location"]
    product = F.replace("material_code", F.lit("MAT"), F.lit("API")).alias("product_code")
    figures = {"planned_qty": "sap_planned", "actual_qty": "sap_actual", "total_cost": "total_cost"}
    # Amounts are summed as decimals: exact, so the average does not depend on the order of partial sums.
    exact = {"total_cost": "decimal(38,12)"}
    sums = [F.sum(F.col(c).cast(exact.get(c, "double"))).alias(f"_sum_{c}") for c in figures]
    counts = [F.count(c).alias(f"_n_{c}") for c in figures]
    combos = sap.groupBy(product, "plant", "storage_location", "uom", "cost_center", "currency").agg(
        *sums, *counts, F.max("posting_date").alias("posting_date")
    )
    return combos.groupBy(*keys).agg(
        *[ratio(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(name) for c, name in figures.items()],
        F.min("uom").alias("sap_uom"),
        F.max("posting_date").alias("posting_date"),
        F.min("cost_center").alias("cost_center"),
        F.min("currency").alias("currency"),
    )


def production_orders(orders: DataFrame, sap: DataFrame) -> DataFrame:
    """Orders with the stock profile of their product posted nearest to the order's start."""
    wanted = orders.select(
        "order_id",
        "batch_id",
        "product_code",
        "line_id",
        F.col("quantity").cast("double").alias("_quantity"),
        F.col("uom").alias("_uom"),
        "planned_start",
        "actual_start",
        "actual_end",
        F.upper("status").alias("status"),
    )
    matched = nearest_dated(
        wanted,
        stock_profiles(sap),
        key="product_code",
        fact_ts="actual_start",
        candidate_date="posting_date",
        prefer=["cost_center", "plant", "storage_location"],
    )
    made = F.coalesce("sap_actual", F.lit(0.0))
    yield_ratio = ratio(made, F.coalesce("sap_planned", F.lit(0.0)))
    return matched.select(
        "order_id",
        "batch_id",
        "product_code",
        "line_id",
        "plant",
        "storage_location",
        F.coalesce("sap_planned", "_quantity").alias("planned_qty"),
        F.coalesce("sap_actual", "_quantity").alias("actual_qty"),
        F.coalesce("sap_uom", "_uom").alias("uom"),
        "planned_start",
        "actual_start",
        "actual_end",
        "status",
        "posting_date",
        "cost_center",
        "total_cost",
        "currency",
        F.round(yield_ratio * 100, 2).alias("yield"),
        F.round(ratio(F.coalesce("total_cost", F.lit(0.0)), made), 2).alias("cost_per_unit"),
        F.when(yield_ratio >= HIGH_YIELD, "HIGH").when(yield_ratio >= FAIR_YIELD, "MEDIUM").otherwise("LOW").alias(
            "production_efficiency"
        ),
    )


# Payload fields that a column is computed from, where it is not the field of its own name.
_MADE_OF = {
    "scrap_pct": ("scrap_percentage",),
    "duration_minutes": ("start_time", "end_time"),
    "pass_fail_flag": ("result",),
    "spec_status": ("usl", "lsl"),
    "severity_score": ("severity",),
    "days_to_close": ("status", "detected_at"),
    "is_open": ("status",),
    "days_open": ("opened_date", "actual_close_date"),
    "is_overdue": ("actual_close_date", "target_close_date"),
    "sla_breach_flag": ("opened_date", "actual_close_date"),
}


def _parsed(raw: DataFrame, names: list[str], always: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Raw envelope rows with the payload's fields as text columns.

    A field that is read costs time for every row, also where nobody uses it: the optimizer drops no column of a
    generator. With ``columns`` (those wanted of the silver table) only their fields and the ``always`` ones, on which the
    choice of rows depends, are read; the others are NULL.
    """
    used = set(names) if columns is None else set(always).union(*[_MADE_OF.get(c, (c,)) for c in columns])
    read = [n for n in names if n in used]
    parsed = with_json_fields(raw.select("_raw_payload", *_ENVELOPE_TAIL), F.col("_raw_payload"), read).drop("_raw_payload")
    return parsed.select("*", *[F.lit(None).cast("string").alias(n) for n in names if n not in used])


def _wanted(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return df if columns is None else df.select(*columns)


def _newest_version(df: DataFrame, key: str) -> DataFrame:
    return keep_latest(df, [key], _NEWEST, ties=[F.col("_row_hash").asc()])


def mes_production_orders(raw: DataFrame, loaded_at: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Production orders from payloads: usable quantities only, with duration and yield.

    With ``columns`` only these, from as few payload fields as they need; the rows are the same.
    """
    got = _parsed(
        raw,
        [
            "order_id",
            "product_code",
            "batch_number",
            "machine_id",
            "operator_id",
            "shift",
            "plant",
            "planned_qty",
            "actual_qty",
            "rejected_qty",
            "scrap_percentage",
            "status",
            "start_time",
            "end_time",
        ],
        always=["order_id", "product_code", "planned_qty", "actual_qty"],
        columns=columns,
    ).withColumns(
        {
            "planned_qty": F.col("planned_qty").try_cast("int"),
            "actual_qty": F.col("actual_qty").try_cast("int"),
            "rejected_qty": F.col("rejected_qty").try_cast("int"),
            "scrap_pct": F.coalesce(F.col("scrap_percentage").try_cast("double"), F.lit(0.0)),
            "start_time": iso_timestamp(F.col("start_time")),
            "end_time": iso_timestamp(F.col("end_time")),
        }
    )
    usable = got.where(
        F.col("order_id").isNotNull()
        & F.col("product_code").isNotNull()
        & (F.col("actual_qty") >= 0)
        & (F.col("planned_qty") > 0)
    )
    result = _newest_version(usable, "order_id").select(
        "order_id",
        "product_code",
        "batch_number",
        "machine_id",
        "operator_id",
        F.upper("shift").alias("shift"),
        "plant",
        "planned_qty",
        "actual_qty",
        "rejected_qty",
        "scrap_pct",
        upper_trim(F.col("status")).alias("status"),
        "start_time",
        "end_time",
        complete_units("MINUTE", F.col("start_time"), F.col("end_time")).alias("duration_minutes"),
        F.round(ratio(F.col("actual_qty"), F.col("planned_qty")) * 100, 2).alias("yield_pct"),
        "_ingested_at",
        "_row_hash",
        "_ingest_year",
        "_ingest_month",
        "_ingest_day",
        *_loaded(loaded_at),
        F.lit(DATA_OWNER).alias("_data_owner"),
    )
    return _wanted(result, columns)


def iqms_quality_tests(raw: DataFrame, loaded_at: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Quality tests with a numeric result, judged against their specification limits.

    With ``columns`` only these, from as few payload fields as they need; the rows are the same.
    """
    got = _parsed(
        raw,
        [
            "test_id",
            "batch_number",
            "product_code",
            "machine_id",
            "test_type",
            "result_value",
            "usl",
            "lsl",
            "result",
            "analyst_id",
            "equipment_id",
            "tested_at",
            "approved_by",
        ],
        always=["test_id", "result_value"],
        columns=columns,
    ).withColumns({name: F.col(name).try_cast("double") for name in ("result_value", "usl", "lsl")})
    usable = got.where(F.col("test_id").isNotNull() & F.col("result_value").isNotNull())
    value = F.col("result_value")
    outcome = upper_trim(F.col("result"))
    result = _newest_version(usable, "test_id").select(
        "test_id",
        "batch_number",
        "product_code",
        "machine_id",
        upper_trim(F.col("test_type")).alias("test_type"),
        "result_value",
        "usl",
        "lsl",
        outcome.alias("result"),
        "analyst_id",
        "equipment_id",
        iso_timestamp(F.col("tested_at")).alias("tested_at"),
        "approved_by",
        F.coalesce(outcome == "PASS", F.lit(False)).alias("pass_fail_flag"),
        F.round((value - 100.0) / 100.0, 4).alias("deviation_from_mean"),
        F.when(value > F.col("usl"), "ABOVE_USL")
        .when(value < F.col("lsl"), "BELOW_LSL")
        .otherwise("WITHIN_SPEC")
        .alias("spec_status"),
        *_ENVELOPE_TAIL,
        *_loaded(loaded_at),
        F.lit(DATA_OWNER).alias("_data_owner"),
    )
    return _wanted(result, columns)


def iqms_deviations(
    raw: DataFrame, as_of: dt.date, loaded_at: Column | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Deviations from payloads with severity points, age at closure and an open flag.

    With ``columns`` only these, from as few payload fields as they need; the rows are the same.
    """
    got = _parsed(
        raw,
        [
            "deviation_id",
            "batch_number",
            "product_code",
            "defect_code",
            "severity",
            "description",
            "detected_by",
            "detected_at",
            "status",
            "root_cause",
        ],
        always=["deviation_id"],
        columns=columns,
    ).where(F.col("deviation_id").isNotNull())
    cleaned = got.withColumns(
        {
            "severity": upper_trim(F.col("severity")),
            "status": upper_trim(F.col("status")),
            "detected_at": iso_timestamp(F.col("detected_at")),
        }
    )
    result = _newest_version(cleaned, "deviation_id").select(
        "deviation_id",
        "batch_number",
        "product_code",
        "defect_code",
        "severity",
        "description",
        "detected_by",
        "detected_at",
        "status",
        "root_cause",
        severity_score(F.col("severity")).alias("severity_score"),
        F.when(F.col("status") == "CLOSED", F.datediff(F.lit(as_of), F.to_date("detected_at"))).alias("days_to_close"),
        F.coalesce(F.col("status").isin("OPEN", "UNDER_INVESTIGATION"), F.lit(False)).alias("is_open"),
        *_ENVELOPE_TAIL,
        *_loaded(loaded_at),
        F.lit(DATA_OWNER).alias("_data_owner"),
    )
    return _wanted(result, columns)


def trackwise_capas(
    raw: DataFrame,
    as_of: dt.date,
    loaded_at: Column | None = None,
    latest_by_key: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Corrective actions with age, overdue and long-running flags, one row per message.

    ``latest_by_key`` keeps only the newest message of each action. With ``columns`` only these, from as
    few payload fields as they need; the rows are the same.
    """
    got = _parsed(
        raw,
        [
            "capa_id",
            "capa_type",
            "title",
            "description",
            "source",
            "product_code",
            "department",
            "owner",
            "opened_date",
            "target_close_date",
            "actual_close_date",
            "status",
            "effectiveness_verified",
        ],
        always=["capa_id"],
        columns=columns,
    ).where(F.col("capa_id").isNotNull())
    if latest_by_key:
        got = _newest_version(got, "capa_id")
    dated = got.withColumns(
        {name: F.to_date(iso_timestamp(F.col(name))) for name in ("opened_date", "target_close_date", "actual_close_date")}
    )
    today = F.lit(as_of)
    days_open = F.datediff(F.coalesce("actual_close_date", today), F.col("opened_date"))
    overdue = F.col("actual_close_date").isNull() & (today > F.col("target_close_date"))
    result = dated.select(
        "capa_id",
        "capa_type",
        "title",
        "description",
        "source",
        "product_code",
        "department",
        "owner",
        "opened_date",
        "target_close_date",
        "actual_close_date",
        upper_trim(F.col("status")).alias("status"),
        F.coalesce(F.col("effectiveness_verified").try_cast("boolean"), F.lit(False)).alias("effectiveness_verified"),
        days_open.alias("days_open"),
        F.coalesce(overdue, F.lit(False)).alias("is_overdue"),
        F.coalesce(days_open > SLA_DAYS, F.lit(False)).alias("sla_breach_flag"),
        *_ENVELOPE_TAIL,
        *_loaded(loaded_at),
        F.lit(DATA_OWNER).alias("_data_owner"),
    )
    return _wanted(result, columns)


def sap_inventory(sap: DataFrame) -> DataFrame:
    """Purchase orders as stock movements with variance, closing stock and unit cost."""
    planned = F.col("planned_qty").cast("double")
    actual = F.col("actual_qty").cast("double")
    return sap.select(
        "po_number",
        "material_code",
        "plant",
        "storage_location",
        planned.alias("planned_qty"),
        actual.alias("actual_qty"),
        (actual - planned).alias("variance_qty"),
        # greatest() skips NULL; an unknown quantity has an unknown closing stock.
        F.when(actual.isNotNull(), F.greatest(actual, F.lit(0.0))).alias("closing_stock"),
        "uom",
        "posting_date",
        month_start(F.col("posting_date")).alias("report_month"),
        "cost_center",
        "total_cost",
        F.round(ratio(F.col("total_cost"), actual), 2).alias("unit_cost"),
        "currency",
        "_source",
        "_ingested_at",
        "_nifi_flow",
    )


def tms_training(tms: DataFrame) -> DataFrame:
    """Training records with their dates, score and validity typed."""
    return tms.where(F.col("record_id").isNotNull()).select(
        "record_id",
        "employee_id",
        "employee_name",
        "department",
        "training_name",
        "training_category",
        F.col("scheduled_date").try_cast("date").alias("scheduled_date"),
        F.col("completion_date").try_cast("date").alias("completion_date"),
        F.col("score").try_cast("double").alias("score"),
        F.upper("status").alias("status"),
        "trainer_id",
        "training_mode",
        F.col("validity_months").try_cast("int").alias("validity_months"),
        "_source",
        "_ingested_at",
    )
