"""Gold: marts for equipment effectiveness, batch release, quality, compliance, stock and training.

Every join below meets two sides that are already aggregated to their join key, so
no key can be hot by the time rows are shuffled for the join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import complete_units, mean_of_rounded, month_start, percent, ratio
from millrace.plans.silver import batch_events

# Audit label of the marts.
DATA_SOURCE = "lakehouse.gold"

# Traffic-light limits in percent (green from, amber from).
CAPA_CLOSURE_LIMITS = (90.0, 70.0)
TRAINING_LIMITS = (95.0, 80.0)

# Weekly yield limits in percent.
WEEKLY_YIELD_LIMITS = (95.0, 85.0)

# Batch risk scoring.
UNTESTED_PASS_RATE = 50.0
CRITICAL_POINTS, MAJOR_POINTS, MINOR_POINTS = 20.0, 10.0, 3.0
LOW_YIELD_LIMIT, LOW_YIELD_POINTS = 85.0, 15.0
RELEASE_PASS_RATE, REJECT_PASS_RATE = 95.0, 80.0
AMBER_OPEN_DEVIATIONS, AMBER_PASS_RATE = 2, 90.0


def _loaded(loaded_at: Column | None) -> Column:
    return (loaded_at if loaded_at is not None else F.current_timestamp()).alias("_gold_loaded_at")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def _light(value: Column, limits: tuple[float, float]) -> Column:
    green, amber = limits
    return F.when(value >= green, "GREEN").when(value >= amber, "AMBER").otherwise("RED")


def oee_dashboard(mes: DataFrame) -> DataFrame:
    """Hourly event quality and mean readings per machine and product."""
    passed = F.count_if(F.col("status") == "PASS")
    reading = F.col("parameter_value")
    return mes.groupBy("machine_id", F.date_trunc("hour", "event_ts").alias("hour_window"), "product_code").agg(
        F.count(F.lit(1)).alias("total_events"),
        passed.alias("pass_count"),
        F.count_if(F.col("status") == "FAIL").alias("fail_count"),
        percent(passed, F.count(F.lit(1))).alias("quality_rate"),
        F.avg(F.when(F.col("parameter_name") == "temperature", reading)).alias("avg_temp"),
        F.avg(F.when(F.col("parameter_name") == "pressure", reading)).alias("avg_pressure"),
        F.min("event_ts").alias("window_start"),
        F.max("event_ts").alias("window_end"),
    )


def batch_summary(mes: DataFrame, orders: DataFrame, quality: DataFrame) -> DataFrame:
    """One row per produced batch: order figures, deviations, release status and cycle time."""
    produced = batch_events(mes).select(
        "batch_id",
        F.col("product_code").alias("_product"),
        F.col("line_id").alias("_line"),
        F.col("first_event_ts").alias("production_start"),
        F.col("last_event_ts").alias("production_end"),
        F.col("dq_fail_count").alias("_failed_checks"),
    )
    figures = {c: c for c in ("planned_qty", "actual_qty", "total_cost", "cost_per_unit")} | {"yield": "yield_pct"}
    ordered = (
        orders.groupBy("batch_id", "product_code", "line_id")
        .agg(*[F.max(c).alias(name) for c, name in figures.items()])
        .groupBy("batch_id")
        .agg(
            F.min("product_code").alias("product_code"),
            F.min("line_id").alias("line_id"),
            *[F.max(name).alias(name) for name in figures.values()],
        )
    )
    deviating = quality.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_deviations"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_deviations"),
        F.count_if("is_open_deviation").alias("_open"),
    )
    status = (
        F.when((F.col("critical_deviations") > 0) | (F.col("_failed_checks") > 0), "REJECTED")
        .when(F.col("_open") > 0, "UNDER_REVIEW")
        .otherwise("RELEASED")
    )
    seconds = complete_units("SECOND", F.col("production_start"), F.col("production_end"))
    return (
        produced.join(ordered, "batch_id", "left")
        .join(deviating, "batch_id", "left")
        .select(
            "batch_id",
            F.coalesce("product_code", "_product").alias("product_code"),
            F.coalesce("line_id", "_line").alias("line_id"),
            "planned_qty",
            "actual_qty",
            "yield_pct",
            "total_cost",
            "cost_per_unit",
            _zero("total_deviations"),
            _zero("critical_deviations"),
            status.alias("batch_status"),
            "production_start",
            "production_end",
            F.round(seconds / F.lit(3600.0), 2).alias("cycle_time_hours"),
        )
    )


def quality_kpis(batches: DataFrame, quality: DataFrame) -> DataFrame:
    """Daily right-first-time and deviation figures per product.

    A batch with deviations reported on several days (or for several products) counts
    once per such group; that is the defined output.
    """
    resolution = quality.groupBy("batch_id", "product_code", F.to_date("reported_ts").alias("_reported")).agg(
        F.avg("time_to_resolution_hours").alias("_hours")
    )
    both = batches.join(resolution.select("batch_id", "_hours"), "batch_id", "left")
    released = F.count_if(F.col("batch_status") == "RELEASED")
    deviations = F.sum("total_deviations")
    return both.groupBy(F.to_date("production_start").alias("report_date"), "product_code").agg(
        F.count(F.lit(1)).alias("total_batches"),
        released.alias("released_batches"),
        F.count_if(F.col("batch_status") == "REJECTED").alias("rejected_batches"),
        percent(released, F.count(F.lit(1))).alias("right_first_time_pct"),
        F.round(mean_of_rounded(F.col("yield_pct")), 2).alias("avg_yield_pct"),
        deviations.alias("total_deviations"),
        percent(F.sum("critical_deviations"), deviations).alias("critical_deviation_rate"),
        F.round(F.avg("_hours"), 2).alias("avg_resolution_time_hours"),
    )


def production_efficiency(orders: DataFrame) -> DataFrame:
    """Weekly order figures per line with the trend against the line's previous week."""
    weekly = orders.groupBy(F.to_date(F.date_trunc("week", "actual_start")).alias("week_start"), "line_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("status") == "COMPLETE").alias("completed_orders"),
        F.round(mean_of_rounded(F.col("yield")), 2).alias("avg_yield_pct"),
        F.round(mean_of_rounded(F.col("cost_per_unit")), 2).alias("avg_cost_per_unit"),
    )
    high, fair = WEEKLY_YIELD_LIMITS
    current = F.col("avg_yield_pct")
    # One row per line and week: the window holds a calendar, not the orders.
    prior = F.lag("avg_yield_pct").over(Window.partitionBy("line_id").orderBy(F.col("week_start").asc_nulls_last()))
    return (
        weekly.withColumn("_prior", prior)
        .withColumn("efficiency_category", F.when(current >= high, "HIGH").when(current >= fair, "MEDIUM").otherwise("LOW"))
        .withColumn(
            "trend_vs_prior_week",
            F.when(current > F.col("_prior"), "IMPROVING").when(current < F.col("_prior"), "DECLINING").otherwise("STABLE"),
        )
        .drop("_prior")
    )


def manufacturing_oee(orders: DataFrame, tests: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Availability, performance, quality and their product per machine, plant, shift and day.

    The day's test results of a machine repeat on each of its plant, shift and ingest-day rows.
    """
    production = (
        orders.where(F.col("status").isin("COMPLETED", "IN_PROGRESS", "ON_HOLD") & F.col("start_time").isNotNull())
        .groupBy(
            "machine_id",
            "plant",
            "shift",
            F.to_date("start_time").alias("production_date"),
            F.col("_ingest_year").alias("year"),
            F.col("_ingest_month").alias("month"),
            F.col("_ingest_day").alias("day"),
        )
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("planned_qty").alias("total_planned_qty"),
            F.sum("actual_qty").alias("total_actual_qty"),
            F.sum("rejected_qty").alias("total_rejected_qty"),
            F.count_if(F.col("status") == "COMPLETED").alias("completed_orders"),
            F.count_if(F.col("status") == "ON_HOLD").alias("on_hold_orders"),
            F.coalesce(mean_of_rounded(F.col("yield_pct")), F.lit(0.0)).alias("avg_yield_pct"),
            F.coalesce(F.avg("scrap_pct"), F.lit(0.0)).alias("avg_scrap_pct"),
            F.sum("duration_minutes").alias("total_production_minutes"),
        )
    )
    passed = F.count_if(F.col("result") == "PASS")
    tested = tests.groupBy("machine_id", F.to_date("tested_at").alias("production_date")).agg(
        F.count(F.lit(1)).alias("quality_tests_run"),
        passed.alias("quality_tests_passed"),
        F.round(ratio(passed, F.count(F.lit(1))) * 100, 2).alias("quality_pass_rate_pct"),
    )
    up = ratio(F.col("completed_orders"), F.col("total_orders"))
    speed = F.col("avg_yield_pct") / 100
    good = F.coalesce("quality_pass_rate_pct", F.lit(0.0)) / 100
    return production.join(tested, ["machine_id", "production_date"], "left").select(
        "machine_id",
        "plant",
        "shift",
        "production_date",
        "year",
        "month",
        "day",
        "total_orders",
        "total_planned_qty",
        "total_actual_qty",
        "total_rejected_qty",
        "completed_orders",
        "on_hold_orders",
        "avg_yield_pct",
        "avg_scrap_pct",
        "total_production_minutes",
        F.round(up, 4).alias("availability"),
        F.round(speed, 4).alias("performance"),
        good.alias("quality_rate"),
        F.round(up * speed * good, 4).alias("oee_score"),
        _zero("quality_tests_run"),
        _zero("quality_tests_passed"),
        F.coalesce("quality_pass_rate_pct", F.lit(0.0)).alias("quality_pass_rate_pct"),
        _loaded(loaded_at),
        F.lit(DATA_SOURCE).alias("_data_source"),
    )


def quality_risk(
    orders: DataFrame, tests: DataFrame, deviations: DataFrame, loaded_at: Column | None = None
) -> DataFrame:
    """Release status, risk score and traffic light per product batch seen by any of the three systems."""
    key = ["product_code", "batch_number"]
    made = orders.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_production_orders"),
        F.sum("actual_qty").alias("total_actual_qty"),
        F.sum("rejected_qty").alias("total_rejected_qty"),
        mean_of_rounded(F.col("yield_pct")).alias("avg_yield_pct"),
    )
    passed = F.count_if("pass_fail_flag")
    tested = tests.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_tests"),
        passed.alias("passed_tests"),
        F.count_if(~F.col("pass_fail_flag")).alias("failed_tests"),
        F.round(ratio(passed, F.count(F.lit(1))) * 100, 2).alias("pass_rate"),
    )
    severity = F.col("severity")
    deviating = deviations.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_deviations"),
        F.count_if("is_open").alias("open_deviations"),
        F.count_if(severity == "CRITICAL").alias("critical_deviation_count"),
        F.count_if(severity == "MAJOR").alias("major_deviation_count"),
        F.count_if(severity == "MINOR").alias("_minor"),
    )
    # USING joins coalesce the key columns; NULL keys match nothing and stay as rows of their own.
    all_three = made.join(tested, key, "full").join(deviating, key, "full")

    rate = F.col("pass_rate")
    critical = F.coalesce("critical_deviation_count", F.lit(0))
    opened = F.coalesce("open_deviations", F.lit(0))
    release = (
        F.when((critical > 0) | (opened > 0) | rate.isNull(), "PENDING")
        .when(rate >= RELEASE_PASS_RATE, "PASS")
        .when(rate < REJECT_PASS_RATE, "FAIL")
        .otherwise("PENDING")
    )
    score = (
        (F.lit(100.0) - F.coalesce(rate, F.lit(UNTESTED_PASS_RATE)))
        + critical * CRITICAL_POINTS
        + F.coalesce("major_deviation_count", F.lit(0)) * MAJOR_POINTS
        + F.coalesce("_minor", F.lit(0)) * MINOR_POINTS
        + F.when(F.col("avg_yield_pct") < LOW_YIELD_LIMIT, LOW_YIELD_POINTS).otherwise(0.0)
    )
    light = (
        F.when(critical > 0, "RED")
        .when((opened > AMBER_OPEN_DEVIATIONS) | (F.coalesce(rate, F.lit(100.0)) < AMBER_PASS_RATE), "AMBER")
        .otherwise("GREEN")
    )
    return all_three.select(
        *key,
        _zero("total_production_orders"),
        _zero("total_actual_qty"),
        _zero("total_rejected_qty"),
        F.coalesce("avg_yield_pct", F.lit(0.0)).alias("avg_yield_pct"),
        _zero("total_tests"),
        _zero("passed_tests"),
        _zero("failed_tests"),
        F.coalesce(rate, F.lit(0.0)).alias("pass_rate"),
        _zero("total_deviations"),
        _zero("open_deviations"),
        _zero("critical_deviation_count"),
        _zero("major_deviation_count"),
        release.alias("batch_release_status"),
        F.round(F.least(F.lit(100.0), score), 2).alias("overall_risk_score"),
        light.alias("risk_rag_status"),
        _loaded(loaded_at),
        F.lit(DATA_SOURCE).alias("_data_source"),
    )


def compliance_capa(capas: DataFrame, deviations: DataFrame, as_of: dt.date, loaded_at: Column | None = None) -> DataFrame:
    """Corrective-action figures per product, department and opening month, with that month's critical deviations.

    Age and overdue flag are judged at ``as_of`` here, whatever date the silver table was built with.
    """
    today = F.lit(as_of)
    age = F.datediff(F.coalesce("actual_close_date", today), F.col("opened_date"))
    late = F.col("actual_close_date").isNull() & (today > F.col("target_close_date"))
    closed = F.count_if(F.col("status") == "CLOSED")
    summary = capas.groupBy("product_code", "department", month_start(F.col("opened_date")).alias("report_month")).agg(
        F.count(F.lit(1)).alias("total_capas"),
        closed.alias("closed_capas"),
        F.count_if(F.col("status").isin("OPEN", "IN_PROGRESS")).alias("open_capas"),
        F.count_if(late).alias("overdue_capas"),
        F.count_if("effectiveness_verified").alias("effectiveness_verified_count"),
        F.avg(age).alias("avg_days_open"),
        F.max(age).alias("max_days_open"),
        F.round(ratio(closed, F.count(F.lit(1))) * 100, 2).alias("closure_rate_pct"),
    )
    critical = (
        deviations.where(F.col("severity") == "CRITICAL")
        .groupBy("product_code", month_start(F.to_date("detected_at")).alias("report_month"))
        .agg(F.count(F.lit(1)).alias("linked_deviations_critical"))
    )
    return summary.join(critical, ["product_code", "report_month"], "left").select(
        *summary.columns,
        _zero("linked_deviations_critical"),
        _light(F.col("closure_rate_pct"), CAPA_CLOSURE_LIMITS).alias("compliance_rag_status"),
        _loaded(loaded_at),
    )


def sap_inventory(sap: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Monthly stock movement per material, plant and storage location."""
    return (
        sap.groupBy("material_code", "plant", "storage_location", "report_month")
        .agg(
            F.count(F.lit(1)).alias("movement_count"),
            F.sum("planned_qty").alias("planned_stock"),
            F.sum("actual_qty").alias("actual_stock"),
            F.sum("variance_qty").alias("variance_qty"),
            F.sum("closing_stock").alias("closing_stock"),
            F.round(mean_of_rounded(F.col("unit_cost")), 2).alias("avg_unit_cost"),
            F.sum("total_cost").alias("total_cost"),
        )
        .select("*", _loaded(loaded_at))
    )


def training_compliance(tms: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Monthly training completion per department; the light uses the unrounded rate."""
    done = F.count_if(F.col("status") == "COMPLETED")
    share = ratio(done, F.count(F.lit(1)))
    green, amber = TRAINING_LIMITS
    return (
        tms.groupBy("department", month_start(F.col("scheduled_date")).alias("report_month"))
        .agg(
            F.count(F.lit(1)).alias("total_trainings"),
            done.alias("completed_trainings"),
            F.count_if(F.col("status") == "OVERDUE").alias("overdue_trainings"),
            F.round(F.avg("score"), 2).alias("avg_score"),
            F.round(share * 100, 2).alias("completion_rate_pct"),
            _light(share, (green / 100, amber / 100)).alias("compliance_rag_status"),
        )
        .select("*", _loaded(loaded_at))
    )
